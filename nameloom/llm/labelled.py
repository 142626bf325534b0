"""Labelled texts to learn the rules for prose from, written by a generator.

No table holds labels for prose, so the examples are made: sentences in four
languages and what is commonly found instead of them, each in many dresses. The
number of examples is a parameter and bounded by rules.MAX_LABELLED.
"""

from __future__ import annotations

import random

# Sentence frames; {p} a name, {n} a thing, {k} a number.
FRAMES = {
    "en": ["{p} had not seen the {n} since the war, but she remembered them well.", "When the {n} arrived, {p} was already on the way to {p}.", "It is said that {k} {n} were lost in {p} and never found.", "We asked {p} whether the {n} could be repaired; he did not know.", "“Who has taken my {n}?” {p} asked, and nobody answered.", "In spring {p} sells {n} and {n} at the market of {p}.", "Because of the {n} the people of {p} stayed at home.", "{p} wrote about the {n}, the {n} and {k} other things."],
    "de": ["{p} hatte die {n} seit dem Krieg nicht gesehen, aber sie erinnerte sich gut.", "Als die {n} kamen, war {p} schon auf dem Weg nach {p}.", "Man sagt, dass in {p} {k} {n} verloren gingen und nie wieder auftauchten.", "Wir fragten {p}, ob man die {n} reparieren kann; er wusste es nicht.", "„Wer hat meine {n} genommen?“ fragte {p}, und niemand antwortete.", "Im Frühling verkauft {p} {n} und {n} auf dem Markt von {p}.", "Wegen der {n} blieben die Leute von {p} zu Hause.", "{p} schrieb über die {n}, die {n} und {k} andere Dinge."],
    "fr": ["{p} n'avait pas vu les {n} depuis la guerre, mais elle s'en souvenait bien.", "Quand les {n} sont arrivés, {p} était déjà sur la route de {p}.", "On dit que {k} {n} ont été perdus à {p} et jamais retrouvés.", "Nous avons demandé à {p} si les {n} pouvaient être réparés ; il ne le savait pas.", "« Qui a pris mes {n} ? » a demandé {p}, et personne n'a répondu.", "Au printemps, {p} vend des {n} et des {n} au marché de {p}.", "À cause des {n}, les gens de {p} sont restés chez eux.", "{p} a écrit sur les {n}, les {n} et {k} autres choses."],
    "zh": ["{p}从战争以后就没有见过{n}，可是还记得很清楚。", "{n}到的时候，{p}已经在去{p}的路上了。", "听说{p}丢了{k}件{n}，再也没有找到。", "我们问{p}能不能修好{n}，他说不知道。", "“谁拿走了我的{n}？”{p}问，没有人回答。", "春天里，{p}在{p}的集市上卖{n}和{n}。", "因为{n}的事，{p}的人都留在家里。", "{p}有{k}件{n}，比以前还多，却还想要{n}。", "{p}昨天早上在{p}附近清点了{n}和{n}。", "{p}深秋写信谈到{n}、{n}和另外{k}件事。"],
}
NOUNS = {
    "en": "apples candles cups doors engines feathers flags forks guitars hammers islands jackets knives leaves mills nails ovens paintings pencils plates rivers saddles ships spoons stairs towers trees trumpets walls wells".split(),
    "de": "Äpfel Kerzen Tassen Türen Motoren Federn Fahnen Gabeln Gitarren Hämmer Inseln Jacken Messer Blätter Mühlen Nägel Öfen Bilder Stifte Teller Flüsse Sättel Schiffe Löffel Treppen Türme Bäume Trompeten Mauern Brunnen".split(),
    "fr": "pommes bougies tasses portes moteurs plumes drapeaux fourchettes guitares marteaux îles vestes couteaux feuilles moulins clous fours tableaux crayons assiettes rivières selles navires cuillères escaliers tours arbres trompettes murs puits".split(),
    "zh": "苹果 蜡烛 茶杯 房门 机器 羽毛 旗子 叉子 吉他 锤子 海岛 外套 小刀 树叶 磨坊 钉子 炉子 油画 铅笔 盘子 河流 马鞍 大船 勺子 楼梯 高塔 树木 喇叭 围墙 水井".split(),
}
_LATIN, _HAN = "ba de fi go lu ma ne pi ro sa te vo ka mi no ri".split(), "巴德菲戈卢马内皮罗萨特沃卡米诺里科达莱基佩维洛"
_CHARS_ZH = "的了在是和有不也而到从比还都这那个我们你他说问去来看听写买卖找人家事天年上下里外前后多少大小好"


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def name(self, lang: str) -> str:
        k = self.r.randint(2, 4)
        return "".join(self.r.choice(_HAN) for _ in range(k)) if lang == "zh" else "".join(self.r.choice(_LATIN) for _ in range(k)).capitalize()

    def noun(self, lang: str) -> str:
        return self.r.choice(NOUNS[lang])

    def sentence(self, lang: str) -> str:
        s = self.r.choice(FRAMES[lang])
        while "{p}" in s:
            s = s.replace("{p}", self.name(lang), 1)
        while "{n}" in s:
            s = s.replace("{n}", self.noun(lang), 1)
        return s.replace("{k}", str(self.r.randint(2, 99)))

    def thing(self, lang: str) -> str:
        return self.noun(lang) if self.r.random() < 0.6 else self.name(lang)

    def prose(self, lang: str) -> str:
        r = self.r
        n = r.choice([1, 1, 2, 2, 3, 4, 6, 9, 14])
        s = [self.sentence(lang) for _ in range(n)]
        gap = "" if lang == "zh" else " "
        dress = r.randrange(9)
        if dress == 0:
            return "\n".join(x.rstrip(".。") for x in s)
        if dress == 1:
            mark = r.choice(["- ", "* ", "– ", "• ", "> "])
            return "\n".join(mark + x for x in s)
        if dress == 2:
            mark = r.choice([".", ")"])
            return "\n".join(f"{i + 1}{mark} {x}" for i, x in enumerate(s))
        text = gap.join(s)
        if dress == 3:
            return text[: r.randint(max(12, len(text) // 2), len(text))]
        if dress == 4:
            width = r.randint(18, 70)
            return "\n".join(text[i : i + width] for i in range(0, len(text), width))
        if dress == 5:
            return self.noun(lang).upper() + "\n" + text
        if dress == 6 and n > 1:
            return text + "".join(f"\n- {self.noun(lang)}" for _ in range(r.randint(1, min(n, 4))))
        if dress == 7:
            return "\n".join(s)
        return text

    def other(self, lang: str) -> str:
        r = self.r
        n = r.choice([r.randint(5, 12), r.randint(8, 40)])
        kind = r.randrange(15)
        number = lambda: f"{r.random() * 10 ** r.randint(0, 4):.2f}"
        if kind == 0:
            mark = r.choice("-*•·+")
            body = "\n".join(f"{mark} {self.noun(lang)}" + (f" {self.name(lang)}" if r.random() < 0.4 else "") for _ in range(n))
        elif kind == 1:
            mark = r.choice([".", ")"])
            body = "\n".join(f"{i + 1}{mark} {self.name(lang)}, {self.noun(lang)}" for i in range(n))
        elif kind == 2:
            width = r.randint(2, 5)
            cell = lambda: r.choice([self.thing(lang), str(r.randint(1, 9999))])
            body = "\n".join("| " + " | ".join(cell() for _ in range(width)) + " |" for _ in range(n))
        elif kind == 3:
            width, sep = r.randint(2, 6), r.choice(["\t", ";", ","])
            body = "\n".join(sep.join(number() for _ in range(width)) for _ in range(n))
        elif kind == 4:
            body = "\n".join("\t".join([self.name(lang), self.name(lang), r.choice(["true", "false"])]) for _ in range(n))
        elif kind == 5:
            body = r.choice([" | ", " > ", " / ", " → ", ", ", "、", " · "]).join(self.thing(lang) for _ in range(n))
        elif kind == 6:
            body = "\n".join(f"[{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}] {r.choice(['OK', 'ERR', 'WARN', 'INFO'])} id={r.getrandbits(32):08x} n={r.randint(1, 999)}" for _ in range(n))
        elif kind == 7:
            body = "\n".join(r.choice(["", "+", "="]).join("".join(r.choice("#$%&*+-<=>@^_~") for _ in range(3)) for _ in range(r.randint(3, 14))) for _ in range(n))
        elif kind == 8:
            body = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFYZ0123456789+/=") for _ in range(r.randint(18, 40))) for _ in range(n // 2 + 2))
        elif kind == 9:
            body = "\n".join(f"{self.noun(lang)}: {r.randint(1, 500)} {r.choice(['kg', '%', 'x', 'cm'])}" for _ in range(n))
        elif kind == 10:
            ends = r.choice(["、；。", "。", "、", "；。"] if lang == "zh" else [";,.", ".", ";.", ","])
            body = "\n".join(self.noun(lang) + r.choice(ends) for _ in range(n))
        elif kind == 11:
            few = " ".join([self.noun(lang)] * r.randint(3, 6) + [self.noun(lang) for _ in range(3)])
            body = few * r.randint(3, 7) + "\n" + "©®™ ¶§ " * r.randint(3, 20)
        elif kind == 12:
            # scrambled: the signs of a language without its order
            if lang == "zh":
                pick = lambda: r.choice([r.choice(_CHARS_ZH), r.choice(_CHARS_ZH), self.noun(lang), str(r.randint(0, 9999)), r.choice("。，")])
                body = "".join(pick() for _ in range(n * r.randint(2, 4)))
            else:
                pick = lambda: r.choice([self.noun(lang), str(r.randint(0, 9999)), r.choice(".,;") + " ", self.noun(lang)[::-1], "".join(r.sample("abcdefghilmnoprstuv", 5))])
                body = " ".join(pick() for _ in range(n * 3))
        elif kind == 13:
            body = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(2, 12))) for _ in range(n * 2))
        else:
            body = "\n".join(r.choice([f"{self.name(lang)}@{self.noun(lang)}.org", f"http://{self.name(lang)}.net/{self.noun(lang)}", f"{self.name(lang)} © {r.randint(1990, 2020)}", f"+{r.getrandbits(36)}"]) for _ in range(n))
        if r.random() < 0.35:
            s = self.sentence(lang)
            body = s[: r.randint(len(s) // 2, len(s))] + "\n" + body
        return body


def examples(n: int = 6000, seed: int = 7) -> list[tuple[str, bool]]:
    """n texts with whether they are other than prose, half of each; the same for a seed."""
    m = _Maker(seed)
    langs = list(FRAMES)
    return [(m.other(langs[i // 2 % 4]), True) if i % 2 else (m.prose(langs[i // 2 % 4]), False) for i in range(n)]

"""Training lines of the personal-information model, from a small grammar of formats: labels come with the lines.

The grammar knows how such items are written by public rules (the numbering plans and identity numbers of some countries, postal
addresses, INID codes of patent front pages) and what words announce them in five languages; whatever else stands in a line
is made at random of function words, syllables, numbers and the other things that patents are full of (citations, standard and
substance numbers, firms, devices named after people). Names of people, towns and firms are random syllables, so the model
can learn no name, only formats, contexts and shapes. No line comes from the documents that are searched.
"""

from __future__ import annotations

import random
import re

from linkframe.llm.names import NICKNAMES

LABELS = ["O", "EMAIL", "PHONE", "IDNUM", "B-PERSON", "I-PERSON", "B-ADDRESS", "I-ADDRESS"]
NUMBER = {name: i for i, name in enumerate(LABELS)}
ONE = {"email": "EMAIL", "phone": "PHONE", "idnum": "IDNUM"}

# Fixed values, by language: words that announce a person, a telephone, an e-mail address, a number of a person, an address;
# titles; function words. {P} person, {E} e-mail, {T} phone, {N} id number, {A} address.
WORDS = {
    "en": {
        "P": "Inventor|Inventors|Agent|Witness|Attorney|Signed|Declared by|Witnessed by|Inventor's name|Attested by", "T": "Tel.|Tel|Phone|Telephone|Fax|Mobile|Call|reached on|reached at", "E": "E-mail|Email|Mail|mailto|Contact|Correspondence",
        "N": "SSN|Social security number|Passport|Passport no.|Identity card no.|Taxpayer|Card|Licence no.", "A": "Address|Residence|Residing at|Resident at|Domiciled at", "title": "Dr.|Prof.|Mr.|Mrs.|Ms.", "by": "by|from|to|with|for|of|at|in|on",
        "plain": "the a an of in on and is was were are at to for from with as who has have had all under before during may be or also not it its one each when upon since here where this these such made then than can will into other no any we",
    },
    "de": {
        "P": "Erfinder|Erfinderin|Vertreter|Vertreterin|Zeuge|Zeugin|Gezeichnet|Unterzeichnet|Anwalt", "T": "Tel.|Telefon|Fax|Telefax|Mobil|Fon|erreichbar unter|Rückruf", "E": "E-Mail|Mail|Rückfragen an|Kontakt",
        "N": "Steuer-ID|Personalausweis Nr.|Ausweis|Reisepass|Sozialversicherung", "A": "Anschrift|Adresse|wohnhaft|Wohnhaft in", "title": "Dr.|Prof.|Herr|Frau|Dipl.-Ing.|Herr Dr.", "by": "durch|von|mit|unter|in|aus|bei",
        "plain": "der die das den dem des ein eine und ist sind im in am zum von mit bei auf nach vor unter hat durch nicht auch wird werden bis aus zur dass so wie wenn dann kann sowie zwischen ohne um beim er sie es",
    },
    "fr": {
        "P": "Inventeur|Inventeurs|Mandataire|Témoin|Signé|Signe|Agent", "T": "Tél.|Tél|Téléphone|Télécopie|Fax|Mobile|joignable au", "E": "Courriel|E-mail|Contact|Mail",
        "N": "N° de sécurité sociale|Pièce d'identité|Passeport|Carte d'identité", "A": "Adresse|demeurant|Domicilié|demeurant au", "title": "M.|Mme|Mlle|Dr|Monsieur|Madame", "by": "par|de|avec|à|chez|sur|au",
        "plain": "le la les un une des du de et est dans sur par à au aux ont a été qui ne pas pour avec ce cette si on plus sans entre comme il elle sont ou leur",
    },
    "zh": {"P": "发明人|代理人|证人|申请人", "T": "电话|联系电话|传真", "E": "邮箱|联系邮箱|电子邮箱", "N": "身份证号|身份证|护照号|证件号", "A": "地址|住址", "title": "先生|女士", "by": "由", "plain": "的在中以及所述一种其与和为可了"},
    "ja": {"P": "発明者|代理人|証人|【発明者】|【氏名】", "T": "電話|電話番号|連絡電話", "E": "連絡先|メール|電子メール", "N": "旅券番号|番号|身分証番号", "A": "住所|【住所】|居所", "title": "氏|様", "by": "は", "plain": "のはをにがとでもからまでした"},
}
# Frames of those words; {w} some words, {.} one, {r} the announcing word, {t} a title, {b} a preposition.
FRAMES = {
    "P": ["{rP}: {P}", "{rP} {P}", "{rP}: {P} {&} {P}", "{rP} : {P}", "(72) {P}", "(72) {rP}: {P}", "(72) {P}; {P}", "(74) {rP}: {P}", "{rP}: {P}, {A}", "(72) {P}, {A}", "(72) {rP}: {P}; {A}", "{rP}: {P}, {T}, {E}", "{rP}: {P}, {rT} {T}", "{P} ({E}, {T})", "{P}, {A}",
          "{t} {P} {w}.", "{w} {t} {P} {w}.", "{w} {b} {P}.", "{w} {b} {P} {w}.", "{P} {w}.", "{w}, {P}, {w}.", "{w} {P} {w}.", "{w} {b} {t} {P}.", "{rP}, {P}, {w}.", "I, {P}, {rA} {A}", "{w} {P} {&} {P} {w}", "{w} {t} {P}, {rN} {N}.", "{rP}: {P}, {rN} {N}, {A}", "{w} {P}, {rN} {N}, {rA} {A}", "{P} {w} {99} {w}."],
    "T": ["{rT} {T}", "{rT}: {T}", "{rT} : {T}", "{w} {rT} {T} {w}", "{w} {b} {T} {w}.", "{T}", "{w} {rT} {T}.", "{rT} {T}, {rT} {T}"],
    "E": ["{rE}: {E}", "{rE} {E}", "{rE} : {E}.", "{w} {b} {E} {w}.", "{w}: {E}.", "{E}", "{rE}:{E}", "{w} {E} {w}", "{w} {E}"],
    "N": ["{rN} {N}", "{rN}: {N}", "{rN} : {N}", "{rN} {N} ({w})", "{w} {rN} {N} {w}.", "{w} {rN} {N}.", "{w} {b} {rN} {N}, {w}"],
    "A": ["{rA}: {A}", "{rA} {A}", "{rA} : {A}", "{A}", "{w} {b} {A}.", "{w} {rA} {A}, {w}.", "{b} {A}, {w}", "{w} {b} {P}, {A}.", "of {A}", "{w} of {A}", "{rN} {N}, of {A}, {w}"],
}
# Frames without anything to be found; {W} a capitalised word, {C} a firm, {D} a device, {X} a citation, {F} a formula, {s} a word that streets are named by but others mean too, {9} digits.
NOTHING = [
    "{w}.", "{w} {99} {w} {99}.", "{F}", "{w} {F} {w}.", "{w} {F}.", "{w} {99} {&} {w} {s}.", "{w} {s} {99} {w} {s} {w}.", "{w} {s} {s} {w}.", "{9}. {w} {99} {&} {s} {99}, {w}.", "{w}, {F} = {F}, {w}.", "{9}. {w} {99}, {w} {F}.", "{w} {F} {F} {w}.", "{99}", "{w} {99}", "{w} {2000}/{999999} {w}.", "{w} = 0.{99} {w}.", "{w} 0.{99} {u} {w} 0.{9}.", "{w} 0.{999} {b} {99}.{99} {u}.", "{w} {X} {&} {X} {w} {99}.{999} %.", "{w} {9}.{9} {u} {w}.", "{w} {99} {b} {999} {u}.", "{W}", "{W} {W}", "{C}", "{C}, {W}", "{w} {C} {w} {W}.", "{w} {b} {C}.", "{C} {w} {W} {99} {w} {2000}.", "{w} {D} {w} {99}.", "{w} {D} {w}; {X}.", "{X} {w}.", "{w} {X} {w}.",
    "{w} {X} {&} {X} {w}.", "[{9999}] {w} {99} {w}.", "{9}. {w} {99}, {w} {9} {&} {9}, {w}.", "({99}) {W}", "({57}) {w}", "{w} {W} {w}.", "{w} {W} {W} {D}.", "{w} {b} {W}.", "{w} ({W}) {w} {99}.", "{w} {9}:{99}, {w} {9}:{999} ({w} {9} {u}).", "{WW}", "{w} = {9}.{99} {w} {W} {9}.",
    "{w} {t} {W} {w}.", "{rP}: {C}", "{rP} {w} {w}.", "{w} {rP} {w}.", "{w} {b} {C} {b} {W}", "{rT} {w} {w}", "{w} {W}-{W} {w}.", "{w} {u} {99} {w}", "{w} {99}-{99} {w} {99}/{99}.", "{w}: {99}, {99} {&} {99}.", "A-{9} {w} A-{9} {w} {999} {u} {99} {u}.",
]
UNITS = "mm|cm|kg|g|ml|kPa|°C|%|rpm|h|µm|s".split("|")
HANZI = "装置方法部件温度压力阀门结构表面连接材料电极轴承弹簧"
KANJI = "装置方法部材温度圧力弁構造表面接続材料電極軸受発条"
PROVINCES = "广东 浙江 江苏 山东 河南 四川 湖北 湖南 河北 福建".split()


class Grammar:
    def __init__(self, seed: int = 5):
        self.r = random.Random(seed)
        self.given = [g.capitalize() for g in NICKNAMES] + ["André", "Søren", "Zoë", "Björn"]
        self.lang = "en"

    def word(self, least: int = 2) -> str:
        return "".join(self.r.choice("b d dr f g gr h j k kl l m n p pl r s t tr v z br".split()) + self.r.choice("a e i o u ai en or un".split()) for _ in range(self.r.randint(least, 4))) + self.r.choice(["", "n", "sk", "th", "rd", "lov", "by", "shaw", "ck"])

    def name(self) -> str:
        return self.word().capitalize()

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNOPQRSTVWXYZ") for _ in range(n))

    def digits(self, n: int) -> str:
        return self.r.choice("123456789") + "".join(self.r.choice("0123456789") for _ in range(n - 1))

    def person(self) -> str:
        r = self.r
        if self.lang == "ja":
            k = lambda: "".join(r.choice("アカサタナハマヤラワイキシチニミリレロノメモドヴ") for _ in range(r.randint(2, 5)))
            return f"{k()}・{k()}"
        if self.lang == "zh":
            k = lambda: "".join(r.choice("达洛维米贝尔雷诺瓦森拉特卡里") for _ in range(r.randint(2, 4)))
            return f"{k()}·{k()}"
        given = r.choice(self.given) if r.random() < 0.5 else self.name()
        last = self.name()
        if r.random() < 0.06:
            last += "-" + self.name()
        middle = f" {self.letters(1)}." if r.random() < 0.18 else ""
        particle = r.choice(["van der ", "von ", "van ", "de "]) if r.random() < 0.12 else ""
        form = r.random()
        if form < 0.14:
            return f"{last}, {given}{middle}"
        if form < 0.26:
            return f"{given[0]}.{middle} {particle}{last}"
        if form < 0.29:
            return f"{given[0]}. {self.letters(1)}. {last}"
        text = f"{given}{middle} {particle}{last}"
        return text.upper() if r.random() < 0.12 else text

    def email(self) -> str:
        r = self.r
        user = r.choice([self.word(), f"{self.word()}.{self.word()}", f"{self.word()}_{r.randint(1, 99)}", f"{self.word()}+{self.word()[:3]}", f"{self.word()}-{self.word()}"])
        host = self.word() + r.choice(["", "-" + self.word()[:3]])
        at, dot = r.choice([("@", ".")] * 8 + [(" [at] ", "."), ("(at)", "(dot)"), (" @ ", "."), ("＠", "."), (" AT ", " DOT ")])
        out = f"{user}{at}{r.choice(['', 'mail.', 'post.']).replace('.', dot)}{host}{dot}{r.choice(['com', 'de', 'fr', 'org', 'net', 'example'])}"
        return out.upper() if r.random() < 0.1 and "[" not in out else out

    def phone(self) -> str:
        """By the numbering plans of the United States, Britain, Germany, France, China and Japan."""
        r, d = self.r, self.digits
        wide = str.maketrans("0123456789-", "０１２３４５６７８９－")
        return r.choice(
            [f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1{d(10)}", f"+44 (0){d(4)} {d(6)}", f"0{d(4)} {d(3)} {d(3)}", f"0{d(4)} {d(6)}", f"+44 {d(4)} {d(6)}", f"+44 (0){d(2)} {d(4)} {d(4)}",
             f"(0{d(2)}) {d(5)} {d(3)}", f"+49 (0){d(2)} {d(5)} {d(3)}", f"+49 {d(2)} {d(8)}", f"0049 {d(2)} {d(8)}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(3)} / {d(6)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}",
             f"+86 {d(2)} {d(4)} {d(4)}", f"+86 {d(11)}", f"0{d(3)}-{d(7)}", f"0{d(2)}-{d(8)}", f"0{d(1)}-{d(4)}-{d(4)}", f"+81 {d(1)} {d(4)} {d(4)}", f"0{d(1)}-{d(4)}-{d(4)}".translate(wide)]
        )

    def idnum(self) -> str:
        """Social security, insurance, tax and identity numbers and passports, by the rules of several countries."""
        r, c = self.r, self.letters

        def d(n: int) -> str:  # leading zeros are digits like others, and frequent
            zeros = min(n, r.choice([0, 0, 0, 1, 2]))
            return "0" * zeros + (self.digits(n - zeros) if n > zeros else "")

        return r.choice(
            [f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{c(2)} {d(2)} {d(2)} {d(2)} {c(1)}", f"{c(2)}{d(6)}{c(1)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"{self.digits(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", self.digits(15), d(18), d(17) + "X", f"{c(1)}{d(8)}",
             f"{c(2)}{d(7)}", f"{c(1)}0{c(1)}{d(5)}{c(1)}{d(1)}", f"{c(2)}-{d(3)}-{d(4)}", f"{c(1)}-{d(3)}-{d(5)}", "0" * 6 + d(12)]
        )

    def address(self) -> str:
        r, d, w = self.r, self.digits, self.name
        n = str(r.randint(1, 399))
        if self.lang == "ja":
            k = lambda: "".join(r.choice("ハナタレリロヴド") for _ in range(r.randint(2, 3)))
            return f"{r.choice(['青森', '長野', '福井', k()])}県{k()}市{r.choice(['', k() + '町'])}{r.randint(1, 9)}丁目{r.randint(1, 29)}番{r.choice(['', '地'])}{r.randint(1, 29)}号"
        if self.lang == "zh":
            k = lambda: "".join(r.choice("达洛维米贝尔雷诺") for _ in range(2))
            return f"{r.choice(PROVINCES)}省{k()}市{k()}{r.choice(['路', '街', '大街'])}{n}号{r.choice(['', f'{d(3)}室'])}"
        code, post = f"{self.letters(2)} {d(5)}", f"{self.letters(r.choice([1, 2]))}{d(1)}{r.choice(['', d(1)])} {d(1)}{self.letters(2)}"
        road = r.choice(["Street", "Road", "Lane", "Avenue", "Ave", "Drive", "Square", "Place"])
        stand = r.choice([", ", "\n"])
        town = r.choice([w(), w() + r.choice(["ville", "burg", " Ford", "-les-" + w()])])
        return r.choice(
            [
                f"{n} {w()} {road}, Apt. {r.randint(1, 40)}, {town}, {code}", f"Flat {r.randint(1, 20)}, {n} {w()} {road}{stand}{town}{stand}{post}", f"P.O. Box {d(r.choice([3, 4, 5, 6]))}, {town}", f"{r.choice(['Flat', 'Apt.', 'Apartment'])} {r.randint(1, 90)}, {n} {w()} {road}\n{town}\n{post}", f"{n} {w()} {w()} {road}, {town}, {post}", f"{n}{r.choice('AB')} {r.choice(['North', 'South', 'East', 'West'])} {w()} {road}, {town}, {code}",
                f"{n} {w()} {road}{stand}{town}, {code}", f"{n} {w()} {road}, {town}, {post}", f"{w()}straße {n}{r.choice(['', 'a', 'b'])}{stand}{r.choice(['', 'D-'])}{d(5)} {town}", f"{r.choice(['Am', 'Im', 'An der'])} {w()}{r.choice(['hof', 'weg', 'platz'])} {n}, {r.choice(['', 'D-'])}{d(5)} {town}", f"{w()}er {r.choice(['Weg', 'Straße', 'Allee', 'Platz'])} {n}{stand}{d(5)} {town}",
                f"{n}{r.choice(['', ' bis', ' ter'])}{r.choice([',', ''])} {r.choice(['rue', 'avenue', 'quai', 'boulevard', 'place', 'chemin', 'rue des', 'rue de la'])} {w()}{stand}{r.choice(['', 'F-'])}{d(5)} {town}", f"{n}, {r.choice(['rue', 'avenue', 'quai'])} {w()} {w()}, {r.choice(['', 'F-'])}{d(5)} {town}",
            ]
        )

    def some(self, least: int = 1, most: int = 6) -> str:
        """Words that mean nothing: function words of the language, random ones, now and then a number or a capital."""
        r = self.r
        if self.lang in ("zh", "ja"):
            pool = WORDS[self.lang]["plain"] + (HANZI if self.lang == "zh" else KANJI)
            return "".join(r.choice(pool) for _ in range(r.randint(2, 12))) + (self.digits(r.randint(1, 3)) if r.random() < 0.2 else "")
        plain = WORDS[self.lang]["plain"].split()
        out = []
        for i in range(r.randint(least, most)):
            x = r.random()
            out.append(r.choice(plain) if x < 0.45 else self.word() if x < 0.88 else self.digits(r.randint(1, 3)) if x < 0.94 else self.name() if x < 0.98 or self.lang != "de" else self.name() + "-" + self.name())
            if self.lang == "de" and 0.68 < x < 0.88:
                out[-1] = self.name()  # a noun
            if out[-1][:1].isupper() and i and (i == 1 and self.lang != "de" or i > 1 and out[-2][:1].isupper()):
                out[-1] = r.choice(plain)  # two capitalised words in a row are a name, but where a German sentence begins
        return " ".join(out)

    def citation(self) -> str:
        r, d = self.r, self.digits
        year = str(r.randint(1975, 2024))
        return r.choice(
            [f"US {d(7)}", f"US {d(7)} B{r.randint(1, 2)}", f"EP {d(7)} {r.choice(['A1', 'B1'])}", f"EP {d(1)} {d(3)} {d(3)} B1", f"WO {year}/{d(6)}", f"JP {year}-{d(6)} A", f"DE {d(2)} {year} {d(6)} A1", f"DE {d(2)} {year} {d(7)} A1", f"FR {d(7)} A1", f"CN {d(8)} A", f"CN {d(9)}", f"ISBN {d(3)}-{d(1)}-{d(r.choice([4, 6]))}-{d(r.choice([2, 4]))}-{d(1)}",
             f"ISSN {d(4)}-{d(4)}", f"CAS {d(r.randint(2, 8))}-{d(2)}-{d(1)}", f"lot no. {d(r.randint(4, 7))}-{d(2)}", f"No. {year} {d(6)}.{d(1)}", f"No. {d(2)}/{d(3)},{d(3)}", f"serial no. {d(r.randint(5, 9))}", f"DIN EN {d(4)}", f"ISO {d(4)}-{d(1)}", f"特開{year}-{d(6)}号", f"特許第{d(7)}号", f"test {d(3)}-{d(2)}-{d(3)}", f"tests {year}-{d(2)}-{d(3)}", f"no. {year}-{d(2)}-{d(3)}", f"no. {d(3)}-{d(3)}-{d(2)}"]
        )

    def formula(self) -> str:
        """Symbols, numbers and signs, whole or damaged, with the tags they come in."""
        r, out = self.r, ""
        for _ in range(r.randint(2, 8)):
            symbol = r.choice([self.letters(1), self.letters(1).lower(), self.letters(2), self.letters(1) + self.digits(1), r.choice("αβγΔσ∑√∂λ"), self.digits(r.randint(1, 2)), "CH" + self.digits(1), "exp", "n", "RT", "\ufffd"])
            out += r.choice(["", "(", "<sub>", "&lt;sub&gt;", "_{"]) * (r.random() < 0.3) + symbol + r.choice(["", " ", "-", " = ", " + ", "/", ")", "</sub>", "^", " · ", "&lt;/sub&gt;", "}"])
        return out.strip()

    def line(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        self.lang = r.choice(["en"] * 4 + ["de"] * 2 + ["fr"] * 2 + ["zh", "ja"])
        pattern = r.choice(FRAMES[r.choice("PPPTENA")]) if r.random() < 0.55 else r.choice(NOTHING)
        out, spans = "", []
        for part in re.split(r"(\{[^{}]+\})", pattern):
            text, kind = self.filled(part[1:-1]) if part.startswith("{") else (part, "")
            if self.lang in ("zh", "ja") and not part.startswith("{"):
                text = part.replace(", ", r.choice(["，", " "])).replace(": ", r.choice(["：", "： ", " "])).replace("; ", "；").replace(".", "。") if not part.startswith("(") else part
                text = "" if text == " " and r.random() < 0.8 else text
            if not out and part == "{w}" or out.endswith(". "):
                text = text[:1].upper() + text[1:]
            if kind:
                spans.append((len(out), len(out) + len(text), kind))
            out += text
        if any(k == "address" for *_, k in spans) and spans[-1][1] >= len(out) - 5 and r.random() < 0.6:
            out += "\n"
            out, more = self.after(out)
            spans += more
        return self.changed(out, spans)

    def after(self, out: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A line that follows an address: a heading, any other line, or an item of its own."""
        x = self.r.random()
        if x < 0.3:
            return out + self.r.choice([self.name(), self.name().upper(), f"{self.name()}:", f"({self.digits(2)}) {self.name()}"]), []
        if x < 0.75:
            text = self.some(3, 9)
            return out + self.r.choice([text[:1].upper() + text[1:] + ".", f"{self.digits(1)}. {text}", f"[{self.digits(4)}] {text}"]), []
        key, kind = self.r.choice([("T", "phone"), ("P", "person"), ("N", "idnum")])
        out += self.announced(key) + self.r.choice([" ", ": "])
        text, _ = self.filled(key)
        return out + text, [(len(out), len(out) + len(text), kind)]

    def changed(self, out: str, spans: list) -> tuple[str, list]:
        """With a number of a paragraph before it, or between tags."""
        before = f"[{self.digits(4)}] " if self.r.random() < 0.1 else ""
        if self.r.random() < 0.15:
            before, out = "<p>" + before, out + "</p>"
        n = len(before)
        return before + out, [(a + n, b + n, k) for a, b, k in spans]

    def announced(self, key: str) -> str:
        return self.r.choice(WORDS[self.lang][key].split("|"))

    def filled(self, key: str) -> tuple[str, str]:
        """What stands in a hole, and its kind if it is to be found."""
        r = self.r
        items = {"P": (self.person, "person"), "E": (self.email, "email"), "T": (self.phone, "phone"), "N": (self.idnum, "idnum"), "A": (self.address, "address")}
        if key in items:
            make, kind = items[key]
            return make(), kind
        if key[0] == "r":
            return self.announced(key[1:]), ""
        made = {
            "w": self.some, "t": lambda: self.announced("title"), "b": lambda: self.announced("by"), "&": lambda: {"en": "and", "de": "und", "fr": "et"}.get(self.lang, "、"), "W": self.name, "WW": lambda: " ".join(self.name().upper() for _ in range(r.randint(1, 4))), "u": lambda: r.choice(UNITS),
            "C": lambda: (self.name() + r.choice([" " + self.name(), ""])) + r.choice([" GmbH", " & Co.", " Inc.", " Works", " S.A.", " Ltd.", " AG", " KG", " Corp.", " SARL", " & Cie"]), "X": self.citation, "F": self.formula, "s": lambda: r.choice(["drive", "a drive", "ring", "place", "square", "box", "the drive", "lane", "ring " + str(r.randint(10, 99))]), "2000": lambda: str(r.randint(1975, 2024)), "57": lambda: r.choice(["57", "54", "71", "30", "22", "51"]),
            "D": lambda: r.choice([self.name(), f"{self.name()}-{self.name()}"]) + " " + r.choice(["cell", "taper", "coupling", "gauge", "number", "test", "method", "valve", "law", "effect", "process", "index", "scale"]),
        }
        return (made[key]() if key in made else self.digits(len(key))), ""


def label(spans: list[tuple[int, int]], items: list[tuple[int, int, str]]) -> tuple[int, ...]:
    """Label numbers of tokens, from the items that hold them."""
    out = []
    for s, e in spans:
        got = next(((a, k) for a, b, k in items if a <= s and e <= b), None)
        if got is None:
            out.append(0)
        elif got[1] in ONE:
            out.append(NUMBER[ONE[got[1]]])
        else:
            out.append(NUMBER[("B-" if s == got[0] else "I-") + got[1].upper()])
    return tuple(out)

"""Tokens of text that may hold personal information, and their classes.

E-mail addresses, numbers and codes, and names and addresses in Chinese and Japanese writing are one token each; other
words are tokens by themselves. The model sees only classes: words of a closed list as they are, other words by shape.
"""

from __future__ import annotations

import re
from itertools import chain

from linkframe.llm.names import FORMAL, NICKNAMES, PARTICLES, fold

# Characters that write foreign names in Chinese.
TRANSLIT = "阿埃安奥巴鲍贝比波伯博布达戴丹德迪蒂杜恩尔法菲费弗福盖戈格古哈海汉赫亨胡基吉加杰卡凯坎科克库拉莱兰劳勒雷里利丽莲林琳卢鲁伦罗洛马玛麦曼梅米莫穆纳娜南内尼诺帕佩皮普奇乔琼萨赛桑森沙莎舍史斯思苏索塔泰坦特廷图托瓦万威韦维沃西希夏肖谢辛雅亚延扬耶伊因尤约泽詹珍朱"
# Words whose neighbourhood tells what a token is, by what they tell.
WORDS = {
    "PERSON": "inventor inventors inventeur inventeurs erfinder erfinderin agent agents vertreter vertreterin mandataire signed declared witness witnesses zeuge zeugin temoin attorney anwalt attested sworn applicant signe gezeichnet unterzeichnet",
    "TITLE": "dr prof mr mrs ms sir dame mme mlle herr frau dipl ing monsieur madame",
    "PHONE": "tel fax phone telephone telefon telefax telecopie call called reach reached reachable erreichbar joignable ruckruf mobile mobil fon",
    "MAIL": "mailto mail email courriel correspondence contact ruckfragen kontakt",
    "IDNUM": "ssn passport taxpayer card identity social security steuer personalausweis ausweis piece identite securite sociale reisepass passeport licence license",
    "ADDRESS": "residing residence resident wohnhaft anschrift adresse address demeurant domicilie domiciled",
    "STREET": "street road lane avenue ave rue quai weg strasse str boulevard place chemin drive square allee platz gasse ring flat apt apartment box po",
    "COMPANY": "gmbh inc works ltd limited kg ag corp llc sarl company cie sons werke",
    "DEVICE": "cell taper test tests coupling gauge number valve method law effect process index scale",
    "DOCNO": "lot cas isbn us jp ep wo de fr cn application no nr fig figs table claim claims patent serial example samples figure anspruch tabelle",
    "DIR": "north south east west",
    "UNIT": "mm cm kg g ml kpa rpm h s c hours stunden heures gramm wt degrees um",
}
# Function words of English, German and French.
PLAIN = """the a an of in on by and is was were are at to for from with between as who has have had all under before during may be or also not it its one each when upon since here where this these such made then than can will into other no any we i
der die das den dem des ein eine und ist sind im am zum von mit bei auf nach vor unter hat durch nicht auch wird werden bis aus zur dass so wie wenn dann kann sowie zwischen ohne um ins beim er sie es
le la les un une du de et est dans sur par au aux ont ete qui ne pas pour avec ce cette si chez l d n plus sans entre comme il elle sont ou leur""".split()
WORD_CLASS = {w: k for k, ws in WORDS.items() for w in ws.split()}
KNOWN = set(PLAIN) | set(WORD_CLASS) | PARTICLES
GIVEN = set(NICKNAMES) | set(FORMAL)

_W = r"(?:[^\W\d_　-鿿가-힯ｦ-ﾟ]|(?<=Ã)[\x80-\xbf])"
_W3 = r"[^\W\d_][^\W\d_]"
_DIGIT = "0-9０-９"
#: Kinds of tokens and their patterns (re.X), in the order in which they are tried.
KINDS = {
    "EMAIL": rf"""[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9._+\-]{{0,63}}\s?(?:[@＠]|[\[(]\s?(?:at|AT)\s?[\])]|\sAT\s)\s?[A-Za-zÀ-ÿ0-9\-]+(?:(?:\.|\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?|\sDOT\s)[A-Za-zÀ-ÿ0-9\-]+)+""",
    "CADDR": rf"""[一-鿿]{{2,4}}省[一-鿿]{{1,6}}市[一-鿿]{{1,8}}?[路街道巷][{_DIGIT}]+号(?:[{_DIGIT}]+[室楼])?
     |[㐀-鿿]{{1,4}}?[県都府道](?:[぀-ヿ一-鿿]{{1,8}}?[市区町村]){{1,2}}[぀-ヿ一-鿿]{{0,8}}?[{_DIGIT}]+丁目[{_DIGIT}]+番(?:地)?[{_DIGIT}]*号?""",
    "CNAME": rf"""[ァ-ヴー]{{1,10}}[・･][ァ-ヴー]{{1,10}}|[{TRANSLIT}]{{1,6}}[·・][{TRANSLIT}]{{1,6}}""",
    "PAT": rf"""\((?:7[0-9]|5[0-9])\)(?!\s?[0-9])""",
    "POST": rf"""\b[A-Z]{{1,2}}[0-9][A-Z0-9]?\ [0-9][A-Z]{{2}}\b|\b[A-Z]{{2}}\ [0-9]{{5}}\b(?![-.0-9])|\b[A-Z]{{1,2}}-[0-9]{{4,5}}\b(?![-.0-9])""",
    "CODE": rf"""\b[A-Z]{{2}}\ [0-9]{{2}}\ [0-9]{{2}}\ [0-9]{{2}}\ [A-Z]\b|\b[A-Z]{{1,3}}-[0-9]{{2,4}}-[0-9]{{3,6}}\b(?!-)|\b[A-Z]{{1,3}}[0-9]{{6,}}[A-Z]?\b|\b(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*[0-9][A-Z0-9]*[0-9])[A-Z0-9]{{8,14}}\b""",
    "NUM": rf"""(?:\+|＋)?(?:[(（][{_DIGIT}]+[)）])?[{_DIGIT}]+(?:(?:[ .\-/－ ]?[(（][{_DIGIT}]+[)）][ \-]?|[ .\-/－ ])[{_DIGIT}]+)*(?:[A-Za-z](?![^\W_]))?
     |[(（][{_DIGIT}]{{2,5}}[)）][ \-]?[{_DIGIT}]+(?:[ .\-/][{_DIGIT}]+)*""",
    "WORD": rf"""{_W}+(?:[01]+{_W}+)*(?:(?<={_W3})1(?![{_DIGIT}]))?(?:[-'’]{_W}+(?:[01]+{_W}+)*)*""",
    "KANA": rf"""[ぁ-ゟ]+|[ァ-ヺー]+""",
    "HAN": rf"""[㐀-鿿]""",
    "NL": rf"""\n""",
    "SPACE": rf"""\s+""",
    "OTHER": rf""".""",
}
TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()), re.X | re.S)
HAN_KEPT = set("由人先生氏电话電話号番証证身份旅券住所地址联系邮箱連絡明発发者測量测定")
DIGITS = str.maketrans("０１２３４５６７８９", "0123456789")
STREET_ENDS = ("strasse", "weg", "hof", "gasse", "platz", "allee", "ring")
_WORDS: dict[str, str] = {}
_NUMS: dict[str, str] = {}
MOST_KEPT = 400_000


SCANNED = str.maketrans("01", "ol")


def mended(w: str) -> str:
    """A word without the marks of a wrong decoding or of scanning."""
    if "Ã" in w:
        try:
            w = w.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return w.translate(SCANNED)


def plain_word(w: str) -> str:
    return fold(mended(w))


def word_class(w: str) -> str:
    """Words of the closed lists by what they tell, given names, else the shape."""
    got = _WORDS.get(w)
    if got is None:
        if len(_WORDS) > MOST_KEPT:
            _WORDS.clear()
        raw, w = w, mended(w)
        f = w.lower() if w.isascii() else fold(w)
        if f[:2] in ("d'", "l'", "d’", "l’"):
            f = f[2:]
        if len(w) == 1:
            got = "I" if w.isupper() else "w:" + f if f in KNOWN else "x1"
        elif f in WORD_CLASS:
            got = WORD_CLASS[f] if f not in ("box", "po", "flat", "apt") else "BOX"
        elif f in GIVEN and w[0].isupper():
            got = "GIVEN"
        elif f in KNOWN:
            got = "w:" + f
        elif w[0].isupper():
            tail = f.endswith(STREET_ENDS) and re.search(rf"({'|'.join(STREET_ENDS)})$", f)
            got = "STREETX" if tail and len(f) > len(tail[0]) + 2 and not w.isupper() else "XX" if w.isupper() and len(w) > 2 else "X2" if w.isupper() else "Xx"
            if "-" in w and got == "Xx":
                got = "Xx" if all(p[:1].isupper() for p in w.split("-")) else "Xx-"
        else:
            got = "xx"
        _WORDS[raw] = got
    return got


def num_class(s: str) -> str:
    """What the writing of a number shows: how many digits, in how many groups, how it begins and is divided."""
    got = _NUMS.get(s)
    if got is None:
        if len(_NUMS) > MOST_KEPT:
            _NUMS.clear()
        t = s.translate(DIGITS).replace("－", "-").replace("（", "(").replace("）", ")").replace("＋", "+")
        groups = [len(g) for g in re.findall("[0-9]+", t)]
        n = sum(groups)
        if len(groups) == 1 and n <= 5:
            got = f"N{n}" + ("a" if t[-1].isalpha() else "")
        else:
            head = "+" if t[0] == "+" else "(" if t[0] == "(" else "00" if t.startswith("00") else "0" if t[0] == "0" else "1"
            size = n if n <= 11 else 13 if n <= 13 else 15 if n <= 16 else 18
            marks = "".join(c for c in " .-/(" if c in t[1:])
            got = f"M{head}|{size}|{min(len(groups), 7)}|{marks}"
        _NUMS[s] = got
    return got


def tokens(text: str, start: int = 0, end: int | None = None) -> tuple[list[tuple[int, int]], tuple[str, ...]]:
    """Spans and classes of ``text[start:end]``; white space other than line breaks is no token."""
    spans, classes = [], []
    for m in TOKEN.finditer(text, start, len(text) if end is None else end):
        kind = m.lastgroup
        if kind == "SPACE":
            continue
        if kind == "WORD":
            c = word_class(m[0])
        elif kind == "NUM":
            c = num_class(m[0])
        elif kind == "HAN":
            c = "h:" + m[0] if m[0] in HAN_KEPT else "han"
        elif kind == "OTHER":
            c = m[0] if m[0] in ".,;:()[]【】：；，。、<>&-/" else "?"
        elif kind == "KANA":
            c = "kana"
        else:
            c = kind
        spans.append((m.start(), m.end()))
        classes.append(c)
    return spans, tuple(classes)


class Classes(dict):
    """Text of a token -> its class; None where the kind depends on what stands around it."""

    def __missing__(self, w: str) -> str | None:
        if len(self) > MOST_KEPT:
            self.clear()
        if w.isascii() and w.isalpha():
            got = word_class(w)
        else:
            # Alone, a text meets every condition on its neighbours, but for the one on a mark before it: no kind is missed.
            alone = tokens(w)[1]
            got = alone[0] if len(alone) == 1 and sum(bool(p.fullmatch(w)) for p in ALONE) < 2 else None
        self[w] = got
        return got


#: A single character of NUM, WORD, KANA or HAN is always taken by these: OTHER, which takes any, comes last.
ALONE = [re.compile(p, re.X | re.S) for k, p in KINDS.items() if k not in ("SPACE", "OTHER")]
CLASSES = Classes()
#: The tokens of a line as texts. Without a sign of an e-mail address that pattern, the slowest, is left out; small letters, also
#: after a capital, before anything but a letter, digit, hyphen or apostrophe can only be a word.
_LINE = {k: p for k, p in KINDS.items() if k not in ("EMAIL", "NL", "SPACE", "OTHER")} | {"OTHER": r"\S|\n"}
_SMALL = r"[A-Z]?[a-z]++(?![^\W_]|['’\-])"
SPLIT = re.compile("|".join(f"(?:{p})" for p in [KINDS["EMAIL"], *_LINE.values()]), re.X | re.S)
SPLIT_PLAIN = re.compile("|".join(f"(?:{p})" for p in [_SMALL, *_LINE.values()]), re.X | re.S)
#: Without what every name or address in Chinese or Japanese writing has, such characters are tokens by themselves and taken together.
SPLIT_HAN = re.compile("|".join(f"(?:{p})" for p in [r"[㐀-鿿]++", _SMALL, *[p for k, p in _LINE.items() if k not in ("CADDR", "CNAME", "HAN")]]), re.X | re.S)
HAN_MARK = re.compile("[・･·]|省.*号|丁目", re.S)
SPACE_NL = re.compile(r"(?<=\s)\n")
MAIL_SIGN = re.compile(r"[@＠]|[\[(]\s?(?:at|AT)|\sAT\s")


def token_texts(line: str, classes: tuple[str, ...] | None = None) -> list[str]:
    """The texts of the tokens of a line, or of joined lines, of such classes if known."""
    if "\n" in line and SPACE_NL.search(line):
        return [line[s:e] for s, e in tokens(line)[0]]
    return (SPLIT if (MAIL_SIGN.search(line) if classes is None else "EMAIL" in classes) else SPLIT_PLAIN).findall(line)


def token_spans(text: str, start: int, end: int, classes: tuple[str, ...]) -> list[tuple[int, int]]:
    """``tokens(text, start, end)[0]``, of such classes."""
    if text.find("\n", start, end) >= 0 and SPACE_NL.search(text, start, end):
        return tokens(text, start, end)[0]
    return [m.span() for m in (SPLIT if "EMAIL" in classes else SPLIT_PLAIN).finditer(text, start, end)]


class HanClasses(dict):
    def __missing__(self, c: str) -> str:
        self[c] = got = "h:" + c if c in HAN_KEPT else "han"
        return got


HAN_CLASSES = HanClasses()


def piece_classes(piece: str, mail: bool = False) -> tuple[str, ...]:
    """``tokens(piece)[1]`` of a part of one line; ``mail``: it may hold the sign of an e-mail address."""
    if "Ã" in piece:
        return tokens(piece)[1]
    if mail:
        got = [CLASSES[w] for w in SPLIT.findall(piece)]
    elif piece.isascii() or HAN_MARK.search(piece):
        got = [CLASSES[w] for w in SPLIT_PLAIN.findall(piece)]
    else:
        got = []
        for w in SPLIT_HAN.findall(piece):
            if "㐀" <= w[0] <= "鿿":
                got += [HAN_CLASSES[c] for c in w]
            else:
                got.append(CLASSES[w])
    return tokens(piece)[1] if None in got else tuple(got)


#: What may hold the sign of an e-mail address.
_MAIL = ("@", "＠", "(", "[", "AT")
_CAPITAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Chunks(dict):
    """What stands between two spaces -> (classes of its tokens, how it may go on into the next one, how into the one before).
    Numbers, postcodes and codes may go on over a space: after a digit, bracket or capital with a digit or bracket, after a
    digit with a single capital."""

    def __missing__(self, chunk: str) -> tuple[tuple[str, ...], int, int]:
        if len(self) > MOST_KEPT:
            self.clear()
        if not chunk:
            got = ((), 0, 0)
        else:
            last, first = chunk[-1], chunk[0]
            digit = last.isdigit()
            after = (1 if digit or last in ")）" or last in _CAPITAL else 0) | (2 if digit else 0)
            before = (1 if first.isdigit() or first in "(（" else 0) | (2 if first in _CAPITAL and not chunk[1:2].isalnum() else 0)
            if chunk.isascii() and chunk.isalpha():
                classes = (word_class(chunk),)
            elif last in ",;:" and chunk[-2:-1].isalnum() or last == "." and chunk[-2:-1].isalpha():  # POST looks for a point after its digits
                classes = (*self[chunk[:-1]][0], last)
            else:
                classes = piece_classes(chunk)
            got = (classes, after, before)
        if len(chunk) <= LONG:
            self[chunk] = got
        return got


class Pieces(dict):
    """Text of chunks that may go on into each other -> classes of its tokens."""

    def __missing__(self, piece: str) -> tuple[str, ...]:
        if len(self) > MOST_KEPT:
            self.clear()
        got = piece_classes(piece)
        if len(piece) <= LONG:
            self[piece] = got
        return got


#: Longer ones are not kept.
LONG = 100
CHUNKS, PIECES = Chunks(), Pieces()


def line_classes(line: str) -> tuple[str, ...]:
    """``tokens(line)[1]`` of one line. No token goes over a space but e-mail addresses, which have a sign, and numbers and codes;
    so what stands between the spaces is looked up, and only where such a token might go on, the text is taken together."""
    if "Ã" in line or (any([x in line for x in _MAIL]) and MAIL_SIGN.search(line)):
        return piece_classes(line, True)
    parts, out, last = line.split(" "), [], 0
    for c in parts:
        classes, after, before = CHUNKS[c]
        if last & before:
            break
        out += classes
        last = after
    else:
        return tuple(out)
    got = [CHUNKS[c] for c in parts]
    out, i = [], 0
    while i < len(got):
        j = i
        while j + 1 < len(got) and got[j][1] & got[j + 1][2]:
            j += 1
        out += got[i][0] if i == j else PIECES[" ".join(parts[i : j + 1])]
        i = j + 1
    return tuple(out)


#: The classes of numbers and codes depend on zeros, ones (as scanned letters) and how many digits there are.
_SAME = bytes.maketrans(b"3456789", b"2222222")
_PAT = re.compile(rb"\([57]")


def alike(text: str) -> str:
    """A text of the same tokens, place by place, and classes, that more texts share: 2 for every larger digit, but not where 7 or
    5 may begin PAT."""
    raw = text.encode("utf-8", "surrogatepass")
    got = raw.translate(_SAME)
    if b"(5" in raw or b"(7" in raw:
        got = bytearray(got)
        for m in _PAT.finditer(raw):
            got[m.end() - 1] = raw[m.end() - 1]
    return got.decode("utf-8", "surrogatepass")


STREETS = {"STREET", "STREETX", "BOX"}


def segments(lines: list[str], of: dict) -> list[tuple[int, int, object]]:
    """Chains (start, end, ``of`` the line) of the lines of a text; lines of which there is nothing have none."""
    out, start = [], 0
    for line in lines:
        end = start + len(line)
        if (what := of[line]) is not None:
            out.append((start, end, what))
        start = end + 1
    return out


def lines_classes(text: str, start: int, end: int, lines: list[tuple[str, ...]]) -> tuple[str, ...]:
    """``tokens(text, start, end)[1]`` of lines of such classes. Over a line break go only e-mail addresses, and what PAT
    looks for after it; white space before it takes it in."""
    if any("PAT" in c for c in lines) or SPACE_NL.search(text, start, end) or MAIL_SIGN.search(text, start, end):
        return tokens(text, start, end)[1]
    return tuple(chain(lines[0], *[("NL", *c) for c in lines[1:]]))


def joined(text: str, chains: list, goes_on, classes_of) -> list:
    """The chains (start, end, what), those for which ``goes_on`` joined with the two lines after the last of them, as an address
    may go on; a blank line ends it. Joined ones are (start, end, classes)."""
    out, i = [], 0
    while i < len(chains):
        j, last = i, i + 2 if goes_on(chains[i][2]) else i
        while j < min(last, len(chains) - 1) and chains[j + 1][0] == chains[j][1] + 1:
            j += 1
            if goes_on(chains[j][2]):
                last = j + 2
        start, end = chains[i][0], chains[j][1]
        out.append(chains[i] if i == j else (start, end, lines_classes(text, start, end, [classes_of(c) for *_, c in chains[i : j + 1]])))
        i = j + 1
    return out

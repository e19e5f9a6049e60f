"""Sentence boundaries by cascading tables of break and no-break rules.

A rule is (breaks, before, after): two regular expressions that must match the text ending at a position and
the text starting there. At each candidate position the rules of the cascade are tried in order and the first
that matches decides. The cascade of a text is the table of its language, then the tables of the other
languages in the same script, then the common table. A cascade is compiled into one alternation of look-behinds and
look-aheads, which sees the whole unit on both sides of the position, however long its runs of white space are.

Candidates lie behind a run of sentence-ending marks (with closing quotes and brackets) and, in Thai, at
spaces. Positions inside a closed quotation or bracket are never candidates. Paragraph ends always break;
a heading or list item on a line of its own is one unit; any other line end is white space.

Defined results: a null, empty or blank text has no sentence; a sentence starts at its first character that
is no white space; offsets count code points; unknown languages use the tables of the script found in the text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import regex

OPEN, CLOSE = "“„«「『(（[【‘", "”“»」』)）]】’"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】"}
ENDS = ".!?…。！？｡।॥؟۔"
CLOSERS = "\"'”“»」』)）\\]】’"

#: A paragraph ends at a blank line or at a separator character.
PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n\u2028\u2029]*(?:\r\n|\n|\r)\s*|[\u2029\x1c-\x1e]\s*")
LINE = re.compile(r"\r\n|[\n\r\u2028\x85\x0b\x0c]")
ITEM = re.compile(r"[^\S\n]*(?:[-*•‣▪·–]|\(?\d{1,3}[.)])[^\S\n]+\S")
HEADING = re.compile(r"[^\S\n]*#{1,6}[^\S\n]+\S")
LONE_LINE = re.compile(r"(?:[-*•‣▪·–]|\(?\d{1,3}[.)]|#{1,6})\s+")
LIST_END = regex.compile(rf"(?<=[{ENDS}:：;][{CLOSERS}]*)|(?<=[฀-๿])|(?<=[฀-๿]\s\d+)")
MARK = re.compile(r"[“”„«»「」『』()（）\[\]【】\"]")
CANDIDATE = re.compile(rf"(?:[{ENDS}]\s?)*[{ENDS}](?:[\"'”»」』)）\]】’]|“(?=[\s,.;:!?]|$))*(?:\s[»”](?!\w))?")
SPACE_AFTER_THAI = re.compile(r"(?<=[฀-๿\d])\s+(?=[฀-๿])")

N, B = False, True


def words(text: str) -> str:
    return "(?:" + "|".join(re.escape(w) for w in text.split()) + ")"


LOW = r"[a-zß-öø-ÿа-яё]"
UP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]"
#: A sentence may begin with a name that is written small, as those of programs: the verb follows at once.
SMALL_NAME = r"\s+[a-z][\w.-]*\s+(?:is|are|was|were|has|had|does|can|will|reads|runs|holds)\b"

#: Abbreviations and ordinal nouns by language.
TABLES: dict[str, list[tuple[bool, str, str]]] = {
    "en": [
        (N, r"\b" + words("Dr Mr Mrs Ms Prof Gen Sen Rep Rev Hon Appx App Approx approx cf vs viz e.g i.e St Capt Messrs") + r"\.", r"\s"),
        (N, r"\b" + words("Fig Figs Sec Secs No Nos Eq Vol Ch p pp v rev ed ver art par cl") + r"\.", r"\s*\d"),
        (B, r"\b(?:U\.S|U\.K|U\.N|E\.U)\.", r"\s+[\"“'(]?[A-Z]|\s+[a-z][\w.-]*\s+(?:is|are|was|were)\s+(?:the|an?)\b"),
        (N, r"\b(?:U\.S|U\.K|U\.N|E\.U)\.", r"\s"),
        (N, r"\b" + words("al Inc Ltd Co Corp Bros Jr Sr a.m p.m Ph.D dept est") + r"\.", rf"\s*(?:{LOW}|\d|,)"),
        (B, r"\betc\.", SMALL_NAME),
        (N, r"\betc\.", rf"\s*(?:{LOW}|[,;:)])"),
    ],
    "de": [
        (N, r"\b" + words("z d u o i v s a m") + r"\.", r"\s*[A-Za-z]\."),
        (N, r"\b(?:z\.\s*B|d\.\s*h|u\.\s*a|o\.\s*ä|i\.\s*d\.\s*R|v\.\s*a|s\.\s*o|m\.\s*E|z\.\s*T)\.", r"\s"),
        (N, r"\b" + words("Dr Prof Fa ca Abb bzw Nr Bd Hr Fr Str vgl evtl ggf inkl Tab Kap Aufl Hrsg Anm Ziff Abs Art Mio Mrd Tsd") + r"\.", r"\s"),
        (N, r"\b" + words("Std Min Sek Jh usw etc") + r"\.", rf"\s*(?:{LOW}|[,;)])"),
        (N, r"(?:^|[\s(])\d{1,2}\.", r"\s+" + words("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Quartal Halbjahr Jahrhundert Auflage Kapitel Platz Tag Woche Monat Mal Stock Klasse") + r"\b"),
        (N, r"(?:^|[\s(])\d{1,3}\.", rf"\s+{LOW}"),
    ],
    "fr": [
        (N, r"\b" + words("M MM Mme Mlle Mgr Dr Pr p ex env cf chap art fig vol éd av apr tél n") + r"\.", r"\s"),
        (N, r"\betc\.", rf"\s*(?:{LOW}|[,;)])"),
    ],
    "es": [
        (N, r"\b" + words("Sr Sra Srta Dr Dra D Dña Prof p ej pág págs fig figs cap caps aprox núm art vol Ud Uds EE tel") + r"\.", r"\s"),
        (N, r"\bEE\.\s*UU\.", rf"\s*(?:{LOW}|[,;)])"),
        (N, r"\betc\.", rf"\s*(?:{LOW}|[,;)])"),
    ],
    "ru": [
        (N, r"\bт\.", r"\s*[декнп]\."),
        (N, r"\bт\.\s*[еко]\.", r"\s"),
        (N, r"\b" + words("Проф проф акад ок см См рис Рис табл Табл стр ул им св доц гл Гл напр") + r"\.", r"\s"),
        (N, r"\b" + words("г гг др тыс млн млрд руб коп д п в вв") + r"\.", rf"\s*(?:{LOW}|[,;:)%]|\d)"),
    ],
    "ar": [(N, r"(?:^|[\s(])" + words("د ص م أ ج ط هـ أ.د") + r"\.", r"\s")],
    "hi": [(N, r"(?:^|[\s(])" + words("डॉ क्र प्रो सं पृ श्री कि मी रु ई") + r"\.", r"\s")],
    "zh": [
        (N, r"…+", r"\s*\S"),
        (N, r"”|』|」|’", r"\s*[的之地这那，、；：,]"),
    ],
    "ja": [
        (N, r"…+", r"\s*\S"),
        (N, r"[」』”]", r"\s*(?:と|って|という|など|は|が|を|に|も|の|へ|で|、)"),
    ],
    "th": [
        (N, r"\d", r"\s+ๆ"),
        (B, r"(?:ปี|ที่|หน้า|ข้อ|พ\.ศ\.|ค\.ศ\.)\s*\d+", r"\s+[฀-๿]"),
        (N, r"\d", r"\s"),
        (N, r"ๆ", r"\s"),
        (N, r"", r"\s+[ๆฯ]"),
        (N, r"(?:ดร|นาย|นาง|พ\.ศ|ค\.ศ|น)\.", r"\s*\S"),
        (B, r"[฀-๿]", r"\s+[฀-๿]"),
    ],
    "common": [
        (N, r"", r"\s*[,;:，、；：،؛]"),
        (N, r"[»”\"“」』]", r"\s*[—–-]"),
        (N, r"(?:\.\s?\.\s?\.|…)", rf"\s*(?:{LOW}|\d)"),
        (N, r"(?:^|[\s(\"“'«.-])[A-ZА-ЯЁ]\.", rf"\s+{UP}"),
        (B, r"[.!?][\"”’'»]+", SMALL_NAME),
        (N, r"[!?]\s?[\"”’'»“]+", rf"\s*{LOW}"),
        (B, r"\.[\"”’'»“)]+", rf"\s+{LOW}"),
        (B, r"[!?]+\)?", rf"\s+{LOW}"),
        (B, r"[^\W\d_]{2,}\.|\d\.|[%)]\.", SMALL_NAME),
        (N, r"\.", rf"\s+{LOW}"),
        (B, r"[。！？｡।॥؟۔][\"'”“»」』)）\]】’]*", r""),
        (B, rf"[.!?…]+\s?[{CLOSERS}]*", r"\s"),
        (B, r"(?:[a-zß-öø-ÿа-яё]{2}|\d|U\.S|[.!?])[.!?]+[\"”’')»]*", r"(?:[A-Z][a-zà-ÿ]|[A-Z]\.\s|[A-Z]\s|[\"“«(][A-Z]|[А-ЯЁ][а-яё])"),
        (B, r"[a-zß-öø-ÿ]{2}[!?]+[\"”’')»]*", r"[\"“«(¿¡]?[A-ZÀ-Þ]"),
        (N, r"", r""),
    ],
}
LATIN, SCRIPTS = ("en", "de", "fr", "es"), (("th", r"[฀-๿]"), ("ja", r"[぀-ヿ]"), ("zh", r"[一-鿿]"), ("hi", r"[ऀ-ॿ]"), ("ar", r"[؀-ۿ]"), ("ru", r"[Ѐ-ӿ]"))
ALIAS = {"jp": "ja", "eng": "en", "ger": "de", "deu": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "hin": "hi", "ara": "ar", "tha": "th", "jpn": "ja", "zho": "zh", "chi": "zh"}
#: Frequent function words that tell the Latin languages apart (fixed values).
FUNCTION_WORDS = {
    "en": set("the of and to in is that it for was with as be on not are this by at from".split()),
    "de": set("der die das und ist nicht ein eine mit von zu den auf wir im des sich wird auch dem".split()),
    "fr": set("le la les des et est un une dans que du en pour pas il au qui par sur ne".split()),
    "es": set("el la los las y es un una en que de del por con no se para al su lo".split()),
}
SCRIPT_RE = [(k, re.compile(v)) for k, v in SCRIPTS]
OTHER_SCRIPT = re.compile("|".join(v for _, v in SCRIPTS))
LETTER, LATIN_WORD = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]+")


def language_of(text: str, hint: str | None = None) -> str:
    """Language of the rules for a text: its script decides, the hint only among languages of one script."""
    code = re.split(r"[-_]", (hint or "").strip().lower())[0]
    code = ALIAS.get(code, code)
    if OTHER_SCRIPT.search(text):
        counts = {k: len(r.findall(text)) for k, r in SCRIPT_RE}
        counts["ja"] *= 4
        best = max(counts, key=counts.get)
        if counts[best] and counts[best] * 6 >= len(LETTER.findall(text)) * (1 if best != "ja" else 2):
            return best
    tokens = LATIN_WORD.findall(text.lower())
    score = {k: sum(map(w.__contains__, tokens)) for k, w in FUNCTION_WORDS.items()}
    top = max(score, key=score.get)
    if score[top] == 0 or (code in score and score[code] == score[top]):
        return code if code in LATIN else "en"
    return top


@cache
def cascade(lang: str) -> regex.Pattern:
    """The rules of a language as one pattern, to be matched at a position: a last group is there where it breaks."""
    family = LATIN if lang in LATIN else (lang,) if lang == "th" else (lang, *(x for x in ("ru", "ar", "hi", "zh", "ja", *LATIN) if x != lang))
    order = [lang, *(x for x in family if x != lang), "common"]
    rules = [(kind, f"(?<={before})" if before else "", f"(?={after})" if after else "") for name in order for kind, before, after in TABLES[name]]
    return regex.compile("|".join(after + before + ("()" if kind else "") for kind, before, after in rules))


def units(text: str) -> list[tuple[int, int]]:
    """Spans that no sentence crosses: paragraphs, and inside them headings and list items on their own lines."""
    out, at = [], 0
    for m in [*PARAGRAPH.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            out += lines(text, at, end)
        at = m.end() if m else end
    return out


def lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    if not LINE.search(text, start, end):
        return [(start, end)]
    out, open_at, at, alone, filled = [], start, start, True, False
    for m in [*LINE.finditer(text, start, end), None]:
        stop = m.start() if m else end
        line = text[at:stop]
        single = bool(HEADING.match(line)) or bool(ITEM.match(line) and (alone or not filled or LIST_END.match(text, behind(text, open_at, at))))
        if single:
            if filled:
                out.append((open_at, at))
            out.append((at, stop))
            open_at, filled = m.end() if m else end, False
        elif not filled:
            filled = bool(line.strip())
        alone = single
        at = m.end() if m else end
    if text[open_at:end].strip():
        out.append((open_at, end))
    return out


def behind(text: str, start: int, at: int) -> int:
    """The end of the last character before a position that is no white space."""
    while at > start and text[at - 1].isspace():
        at -= 1
    return at


def masked(text: str) -> list[tuple[int, int]]:
    """Spans inside closed quotations and brackets, outermost ones, without the closing mark."""
    spans, stack, end = [], [], len(text)
    #: how many open marks wait for a closing mark
    waiting: Counter[str] = Counter()

    def leave() -> tuple[str, int]:
        mark, at = stack.pop()
        waiting.subtract(PAIRS.get(mark, ""))
        return mark, at

    for m in MARK.finditer(text):
        i, c = m.start(), m[0]
        if c == '"':
            opens = (i == 0 or text[i - 1].isspace() or text[i - 1] in "([{“«—–\"'：") and i + 1 < end and not text[i + 1].isspace()
            if stack and stack[-1][0] == '"' and not (opens and text[i - 1].isspace()):
                spans.append((leave()[1], i))
            elif opens:
                while stack and stack[-1][0] == '"':
                    leave()
                stack.append((c, i))
        elif waiting[c] > 0:
            while c not in PAIRS.get(stack[-1][0], ""):
                leave()
            spans.append((leave()[1], i))
        elif c in PAIRS:
            stack.append((c, i))
            waiting.update(PAIRS[c])
    spans.sort()
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if not out or s > out[-1][1]:
            out.append((s, e))
        elif e > out[-1][1]:
            out[-1] = (out[-1][0], e)
    return out


CASELESS_NEXT = re.compile(r"\s*[؀-ۿऀ-ॿ぀-ヿ一-鿿฀-๿]")
ENDS_QUOTED = regex.compile(rf"(?<=[{ENDS}]\s?[”»」』\"]+)")


def stops(unit: str, rules: regex.Pattern, thai: bool) -> list[tuple[int, int]]:
    """Spans of the sentences of one unit, which starts with no white space."""
    spots = [m.end() for m in CANDIDATE.finditer(unit)]
    if thai:
        spots = sorted({*spots, *(m.start() for m in SPACE_AFTER_THAI.finditer(unit))})
    end = len(unit)
    if not spots or spots[0] >= end:
        return [(0, end)]
    closed = masked(unit) if MARK.search(unit) else []
    out, k, first = [], 0, 0
    for p in spots:
        if p >= end:
            break
        while k < len(closed) and closed[k][1] + 1 < p:
            k += 1
        j = k
        while j < len(closed) and closed[j][1] < p:
            j += 1
        if j < len(closed) and closed[j][0] < p <= closed[j][1]:
            continue
        if unit[first] in "“«「『\"‘" and ENDS_QUOTED.match(unit, p) and CASELESS_NEXT.match(unit, p) and not (j and closed[j - 1][0] > first):
            continue
        if rules.match(unit, p).lastindex:
            out.append((first, p))
            first = p
            while first < end and unit[first].isspace():
                first += 1
    if first < end:
        out.append((first, end))
    return out


def sentences(text: str | None, hint: str | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) of the sentences of a text, without surrounding white space."""
    if not text or text.isspace():
        return []
    lang = language_of(text, hint)
    rules = cascade(lang)
    out: list[tuple[int, int]] = []
    for start, end in units(text):
        while start < end and text[start].isspace():
            start += 1
        end = behind(text, start, end)
        if start >= end:
            continue
        if LONE_LINE.match(text, start, end) and (ITEM.match(text, start, end) or HEADING.match(text, start, end)) and not LINE.search(text, start, end):
            out.append((start, end))
            continue
        out += [(start + a, start + behind(text, start + a, start + b) - start) for a, b in stops(text[start:end], rules, lang == "th")]
    return [(a, b) for a, b in out if a < b]

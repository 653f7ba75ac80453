"""PII: offset-preserving deobfuscation.

Identifiers are found twice. The base pass matches fixed patterns on the text as it stands. The second
pass runs a chain of transducers, each of which rewrites a span of characters and keeps, for every
character written, the source span it came from: (1) homoglyphs, full-width and other compatibility
forms become ASCII and invisible characters vanish; (2) runs of spelled digits become digits, with
"dot", "plus" and "dash" read as signs inside such runs; (3) "at" and "dot" in brackets become ``@`` and
``.``; (4) so do bare words in an address that ends in a known top-level domain. Each rewrite depends on
what stands next to it and on nothing else in the text. The same patterns then run on the normalised
text and each hit's first and last characters map it back to the source. A hit that lies inside a base
span adds nothing; any other hit is an added span of its kind.

Defined results: a null text is empty; an empty text has no spans; every text is read whole, in time
linear in its length; repeated rows are judged alike; an empty table gives an empty result; columns
other than the key and the text are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, documents, map_texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_LOCAL_SET = frozenset(_LOCAL)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str):
    """Leftmost addresses by their ``@``: no character is looked at more than a few times."""
    done, at = 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        local = len(head) - len(head.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _ips(text: str):
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


_FINDERS = (_emails, _ips, _cards, _phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of every base match, by kind, then start."""
    return [(k, a, b) for k, find in enumerate(_FINDERS) for a, b in find(text)]


#: Letters of other scripts that look like ASCII ones.
_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝвмнкткАВЕКМНОРСТХУІЈЅ" + "αοινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "ⅼ",
        "aeopcyxijshdqwbmhktkABEKMHOPCTXYIJS" + "aoivptukABEZHIKMNOPTYX" + "l",
    )
)
#: Characters that are not seen.
_UNSEEN = "­​‌‍⁠﻿"
_FOREIGN = re.compile("[" + "".join(_LOOKALIKES) + _UNSEEN + "٠-٩۰-۹‐-―․⁰-₉！-～\U0001d400-\U0001d7ff" + "]")
#: Spelled digits.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SIGNS = {"dot": ".", "point": ".", "plus": "+", "dash": "-", "hyphen": "-"}
_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SIGN = r"(?:dot|point|plus|dash|hyphen)"
_GAP = r"(?:[ \t\r\n]++|-|,[ \t]?)"
_RUN = re.compile(rf"(?i)\b(?=[zotfsenp])(?:plus{_GAP})?{_WORD}(?:{_GAP}(?:{_SIGN}{_GAP})?(?:{_WORD}|[0-9]++)(?![A-Za-z0-9]))++", re.A)
_PIECE = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")
_BRACKET = re.compile(r"[\[({<][ \t]*+(?:[aA][tT]|@|[dD][oO][tT]|\.)[ \t]*+[\])}>][ \t]*+")
_CLOSES = {"[": "]", "(": ")", "{": "}", "<": ">"}
#: Country codes, and generic top-level domains with many registrations.
_COUNTRIES = (
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
    "de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it "
    "je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz "
    "om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz "
    "ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
)
_GENERIC = (
    "aero app art asia bank berlin biz blog cat cloud club com coop design dev digital edu email global gov group info int jobs live ltd mail media mil mobi museum name net network news "
    "ngo ong online org page post pro shop site social software solutions space store studio systems team tech tel today top travel web website wiki work world xxx xyz zone"
)
_TOP = re.compile("(?i)(?:" + "|".join([*_COUNTRIES.split(), *_GENERIC.split(), "xn--[a-z0-9-]+"]) + ")")
#: Fixed values: "at the dot in" is prose, "at example dot in" an address.
_PROSE = re.compile(r"(?i)(?:an?|the|this|that|each|every|any|one|no|some|which|my|your|his|her|its|our|their)[ \t]dot[ \t](?!(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|us)\b)")
_BARE_AT = re.compile(r"@|[ \t][aA][tT][ \t]")
_BARE_DOT = re.compile(r"(?i)[ \t]dot[ \t]")
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_DOT = re.compile(r"(?i)\.|[ \t]dot[ \t]")


class Tape:
    """A text with, for every character, the half-open source span it was read from."""

    def __init__(self, text: str, first: list[int] | None = None, last: list[int] | None = None):
        self.text, self.first, self.last = text, first or list(range(len(text))), last or list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Tape":
        """Replace disjoint, ascending spans; what is written for a span covers the whole of it."""
        text, first, last, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            first += self.first[at:a]
            last += self.last[at:a]
            text.append(new)
            if new:
                first += [self.first[a]] * len(new)
                last += [self.last[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), first + self.first[at:], last + self.last[at:])


def _plain(c: str) -> str:
    if c in _UNSEEN:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if "‐" <= c <= "―":
        return "-"
    new = unicodedata.normalize("NFKC", c)
    if new.isdigit() and not new.isascii():
        return str(unicodedata.digit(new, 0))
    return new if new.isascii() else c


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _RUN.finditer(text):
        words = [(x.start(), x.end(), x[0]) for x in _PIECE.finditer(m[0])]
        digits = sum(1 if w.lower() in _SPELLED else len(w) if w.isdigit() else 0 for _, _, w in words)
        if digits < 4:
            continue
        for a, b, w in words:
            new = _SPELLED.get(w.lower()) or _SIGNS.get(w.lower()) or (w if w.isdigit() else "")
            if new != w:
                edits.append((m.start() + a, m.start() + b, new))
    return edits


def _local_start(text: str, at: int, least: int) -> int:
    """Where the local part that ends at ``at`` begins, not before ``least``; pieces may be joined by a bare dot."""
    begin = at
    while True:
        piece = begin
        while begin > least and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        if begin == piece:
            return min(at, begin + 5) if piece < at else at
        if begin - 5 < least or not _BARE_DOT.fullmatch(text, begin - 5, begin):
            return begin
        begin -= 5


def _domain_end(text: str, at: int) -> int:
    """Where the longest domain from ``at`` that ends in a known top-level domain ends; ``at`` if there is none."""
    end, label = at, _LABEL.match(text, at)
    while label and (dot := _DOT.match(text, label.end())):
        label = _LABEL.match(text, dot.end())
        if label and text[label.end() : label.end() + 1] != "_" and _TOP.fullmatch(label[0]):
            end = label.end()
    return end


def _bare(text: str) -> list[tuple[int, int, str]]:
    """Edits for "at" and "dot" as bare words, outwards from each "at"; every character is read a few times."""
    edits, done = [], 0
    for m in _BARE_AT.finditer(text):
        if m.start() < done or _PROSE.match(text, m.end()):
            continue
        begin = _local_start(text, m.start(), done)
        end = _domain_end(text, m.end()) if begin < m.start() else m.end()
        if end > m.end():
            if m[0] != "@":
                edits.append((m.start(), m.end(), "@"))
            for part in ((begin, m.start()), (m.end(), end)):
                edits += [(x.start(), x.end(), ".") for x in _BARE_DOT.finditer(text, *part)]
            done = end
        else:
            done = m.end() - 1  # the blank after may begin the next "at"
    return edits


def _disguised(text: str) -> list[tuple[int, int, str]]:
    """Edits for "at" and "dot" in brackets; blanks around them go too."""
    edits, done = [], 0
    for m in _BRACKET.finditer(text):
        inside = m[0].rstrip(" \t")
        word = inside[1:-1].strip(" \t").lower()
        if _CLOSES[inside[0]] != inside[-1] or inside[0] == "<" and word == ".":
            continue
        begin = m.start()
        while begin > done and text[begin - 1] in " \t":
            begin -= 1
        edits.append((begin, m.end(), "@" if word in ("at", "@") else "."))
        done = m.end()
    return edits


def normalise(text: str) -> Tape | None:
    """The text after all transducers, or None where none of them has work."""
    tape = None
    for find in (lambda t: [(m.start(), m.end(), _plain(m[0])) for m in _FOREIGN.finditer(t)], _spelled, _disguised, _bare):
        if edits := find(tape.text if tape else text):
            tape = (tape or Tape(text)).rewrite(sorted(edits))
    return tape


def all_spans(text: str) -> tuple[list, list]:
    """Base spans, and base plus added spans, each by kind, then start."""
    base = base_spans(text)
    tape = normalise(text)
    if tape is None:
        return base, base
    by_start = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in by_start]
    reach = [*accumulate((b for _, b in by_start), max)]
    added = set()
    for k, a, b in base_spans(tape.text):
        start, end = tape.first[a], tape.last[b - 1]
        at = bisect_right(starts, start)
        if not at or reach[at - 1] < end:
            added.add((k, start, end))
    return base, sorted({*base, *added})


def show(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _row(text: str) -> tuple:
    base, every = all_spans(text)
    count = [0] * len(KINDS)
    for k, _, _ in base:
        count[k] += 1
    return *count, hashlib.sha256(show(base).encode()).hexdigest(), show(every)


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans of every row of ``df``."""
    return map_texts(df, [key], text, _row, "n_email long,n_ip long,n_card long,n_phone long,base_sha256 string,spans string")


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    _, spans = all_spans(text)
    out, at = [], 0
    merged: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join(out) + text[at:] if merged else text


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its ``text`` redacted and ``n_chars``, if it has one, recounted; null texts stay null."""
    arrow_rows(df.sparkSession)

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(redact, na_action="ignore")

    out = df.withColumn(text, run(F.col(f"`{text}`").cast("string")))
    return out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out


def op8_pii(spark, sf_dir) -> DataFrame:
    return find_pii(documents(spark, sf_dir))

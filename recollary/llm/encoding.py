"""Finding and repairing text that was decoded with the wrong character encoding.

Characters are mapped back to the bytes of the encoding they were wrongly read in, an automaton over the
byte structure of the true encoding (UTF-8, or a Japanese or Chinese two-byte encoding) finds the maximal
well-formed multibyte spans, and only those spans are decoded. Where every character is one byte, the
automaton is compiled into a regular expression over the characters themselves. Western bytes read as
another one-byte encoding have no multibyte structure; what is left of them is told by signs that stand
where no word has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The encodings that text is most often wrongly decoded with.
ONE_BYTE = ["cp1252", "latin-1", "cp1250", "cp1254", "iso8859-15", "mac_roman", "cp437", "cp850"]
TWO_BYTE = ["cp932", "gb18030", "big5", "euc_kr"]
WESTERN = ["cp1252", "latin-1"]
LOST = "\ufffd"


@cache
def byte_of(encoding: str) -> dict[str, int]:
    """Character to byte, for the upper half. Bytes an encoding leaves open are the C1 controls."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


def one_of(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]"


@cache
def utf8_spans(encoding: str) -> re.Pattern[str]:
    """Maximal runs of characters whose bytes in the encoding are well-formed UTF-8 sequences."""
    table = byte_of(encoding)
    pick = lambda a, b: one_of([c for c, x in table.items() if a <= x <= b])
    tail = pick(0x80, 0xBF)
    forms = [
        pick(0xC2, 0xDF) + tail,
        pick(0xE0, 0xE0) + pick(0xA0, 0xBF) + tail,
        pick(0xE1, 0xEF) + tail + "{2}",
        pick(0xF0, 0xF0) + pick(0x90, 0xBF) + tail + "{2}",
        pick(0xF1, 0xF4) + tail + "{3}",
    ]
    return re.compile("(?:" + "|".join(forms) + ")+")


def plausible(text: str) -> bool:
    """Only characters that ordinary text in Latin, kana or Han script is made of."""
    for c in text:
        x = ord(c)
        if not (
            0xA0 <= x <= 0x17F or 0x2010 <= x <= 0x205E or 0x20A0 <= x <= 0x20BF or 0x2100 <= x <= 0x214F or 0x2190 <= x <= 0x21FF
            or 0x2200 <= x <= 0x22FF or 0x2460 <= x <= 0x27BF or 0x3000 <= x <= 0x30FF or 0x3400 <= x <= 0x9FFF or 0xFF00 <= x <= 0xFFEF
            or 0x1F300 <= x <= 0x1FAFF or x in (0x2C6, 0x2DC, 0x192, 0xFEFF)
        ):
            return False
    return True


@cache
def leads_and_tails(encoding: str) -> tuple[frozenset[str], frozenset[str]]:
    table = byte_of(encoding)
    return frozenset(c for c, x in table.items() if x >= 0xC2), frozenset(c for c, x in table.items() if x <= 0xBF)


@cache
def any_pair() -> re.Pattern[str]:
    """A lead and a tail of any of the one-byte encodings: what no garbled sequence is without."""
    both = [leads_and_tails(e) for e in ONE_BYTE]
    return re.compile(one_of([c for leads, _ in both for c in leads]) + one_of([c for _, tails in both for c in tails]))


def undo_utf8(text: str, encoding: str) -> tuple[str, int]:
    """Decode the well-formed UTF-8 spans of text as read in the one-byte encoding; and their length."""
    table, covered = byte_of(encoding), 0

    def decode(m: re.Match[str]) -> str:
        nonlocal covered
        try:
            found = bytes(table[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        if not all(0x80 <= ord(c) < 0x180 or plausible(c) for c in found):
            return m[0]
        if all("\u2500" <= c <= "\u259f" for c in m[0]) and not all("\xa0" <= c <= "\xff" for c in found):
            return m[0]  # a drawn frame
        covered += len(m[0])
        return found

    return utf8_spans(encoding).sub(decode, text), covered


SEQUENCE = rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})"
TOKEN = re.compile(rb"(?P<good>" + SEQUENCE + rb")|(?P<ascii>[\x00-\x7f])|(?P<lost>\xff)|(?P<bad>[\x80-\xfe])", re.DOTALL)
ANY = re.compile(SEQUENCE)
RUN = re.compile("[^\x00-\x7f]+")
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
# so many sequences in a row are no accident; fewer are believed if they are all of a run of wide characters
SURE = 6


def wide_spans(run: str, encoding: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded, in characters of run) of the maximal spans whose bytes in the encoding are UTF-8.

    A lost sign (U+FFFD) stands for bytes that the wrong decoding replaced: it and the rest of the sequence
    it cut stay lost. A character half of whose bytes are in no sequence belongs to no span."""
    sizes, raw = [], bytearray()
    for c in run:
        one = b"\xff" if c == LOST else c.encode(encoding, "ignore") or b"\xfe"
        sizes.append(len(one))
        raw += one
    owner = [i for i, n in enumerate(sizes) for _ in range(n)] + [len(run)]
    tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(bytes(raw))]
    kinds = [t[0] for t in tokens]
    # one or two bad bytes beside a lost sign are the rest of the sequence that it cut
    for at, step in ((range(len(kinds)), 1), (range(len(kinds) - 1, -1, -1), -1)):
        left = 0
        for i in at:
            if kinds[i] == "lost" and tokens[i][0] == "lost":
                left = 2
            elif kinds[i] == "bad" and left:
                kinds[i], left = "lost", left - 1
            else:
                left = 0
    spans, i = [], 0
    while i < len(tokens):
        if kinds[i] == "bad":
            i += 1
            continue
        j = i
        while j < len(tokens) and kinds[j] != "bad":
            j += 1
        a, b = i, j
        while a < b and (owner[tokens[a][1]] == owner[tokens[a][1] - 1] if tokens[a][1] else False):
            a += 1
        while a < b and owner[tokens[b - 1][2]] == owner[tokens[b - 1][2] - 1]:
            b -= 1
        while a < b and kinds[a] == "lost" and tokens[a][0] == "lost":
            a += 1
        if a < b:
            parts = [raw[x:y].decode("utf-8") if kind in ("good", "ascii") else LOST for kind, (_, x, y) in zip(kinds[a:b], tokens[a:b])]
            spans.append((owner[tokens[a][1]], owner[tokens[b - 1][2]], re.sub(LOST + "+", LOST, "".join(parts)), kinds[a:b].count("good")))
        i = j
    found = []
    for start, end, decoded, n in spans:
        signs = [c for c in decoded if c >= "\x80" and c != LOST]
        if not signs or not all(plausible(c) for c in signs):
            continue
        whole = not run[:start].strip(LOST) and not run[end:].strip(LOST)
        wide = sum(c >= "\u2e80" for c in signs)
        if n >= SURE and wide or whole and wide >= 2 and end - start >= 3:
            found.append((start, end, decoded))
    return found


def latin_span(run: str, encoding: str) -> str | None:
    """What a run of one to three wide characters within a Latin word is, if its bytes are UTF-8 of Latin letters
    or of a quotation mark or dash."""
    try:
        decoded = run.encode(encoding).decode("utf-8")
    except UnicodeError:
        return None
    return decoded if all("\xc0" <= c <= "\u017f" and c not in "\xd7\xf7" or "\u2010" <= c <= "\u203a" or c < "\x80" for c in decoded) else None


def undo_utf8_wide(text: str, encoding: str) -> tuple[str, int]:
    """Decode the spans of text whose bytes in the two-byte encoding are UTF-8; and their length."""
    made, at, hits = [], 0, 0
    lone: list[tuple[int, int, str, bool]] = []
    for m in RUN.finditer(text):
        run = m[0]
        if len(run) <= 3:
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if LATIN.match(before) or LATIN.match(after):
                inside = latin_span(run, encoding)
                if inside and run[0] > "\u2e7f":
                    # a sign may have taken the ASCII letter after it
                    lone.append((m.start(), m.end(), inside, bool(LATIN.match(before) and (LATIN.match(after) or inside[-1] < "\x80"))))
                    continue
        if len(run) < 3 or not ANY.search(run.encode(encoding, "ignore")):
            continue
        for start, end, decoded in wide_spans(run, encoding):
            made += [text[at : m.start() + start], decoded]
            at = m.start() + end
            hits += end - start
    if not hits and lone and (len(lone) > 1 or lone[0][3]):
        for start, end, decoded, _ in lone:
            made += [text[at:start], decoded]
            at = end
            hits += end - start
    return "".join(made) + text[at:], hits


# Byte ranges of the two-byte encodings: leads and tails of a character, and single bytes beside ASCII.
STRUCTURE = {
    "euc_jp": ([(0xA1, 0xFE), (0x8E, 0x8E)], [(0xA1, 0xFE)], []),
    "gb18030": ([(0x81, 0xFE)], [(0x40, 0x7E), (0x80, 0xFE)], []),
    "cp932": ([(0x81, 0x9F), (0xE0, 0xFC)], [(0x40, 0x7E), (0x80, 0xFC)], [(0xA1, 0xDF)]),
    "big5": ([(0xA1, 0xF9)], [(0x40, 0x7E), (0xA1, 0xFE)], []),
}


@cache
def legacy_spans(encoding: str) -> re.Pattern[str]:
    """Maximal runs of characters whose bytes, read as cp1252, are well-formed in the two-byte encoding."""
    table = byte_of("cp1252") | {chr(b): b for b in range(0x40, 0x7F)} | {chr(b): b for b in range(0x80, 0xA0)}
    pick = lambda ranges: one_of([c for c, x in table.items() if any(a <= x <= b for a, b in ranges)])
    leads, tails, singles = STRUCTURE[encoding]
    forms = [pick(leads) + pick(tails)] + ([pick(singles)] if singles else [])
    return re.compile("(?:" + "|".join(forms) + ")+")


KANA = re.compile("[\u3041-\u30ff]")
LEGACY = re.compile("[\x80-\xff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]{2}")


def east_asian(found: str) -> float:
    """How much a decoded span looks like Japanese or Chinese: the share of kana and common Han."""
    good = 0
    for c in found:
        x = ord(c)
        good += 0x3040 <= x <= 0x30FF or x in (0x3001, 0x3002, 0xFF0C, 0xFF1F, 0xFF01, 0x30FC) or (0x4E00 <= x <= 0x9FA5 and len(c.encode("gb2312", "ignore") or c.encode("cp932", "ignore")) == 2)
    return good / max(1, len(found))


def undo_legacy(text: str) -> tuple[str, int]:
    """Decode spans of Japanese or Chinese legacy bytes that were read as cp1252; and their length.

    Of the encodings the one whose well-formed spans decode to most of the text's garbled signs is undone;
    kana, in the spans or in the rest of the text, speak for a Japanese one, none for a Chinese one."""
    best = (0.0, text, 0)
    for encoding in STRUCTURE:
        hits = kana = 0
        worth = 0.0

        def decode(m: re.Match[str]) -> str:
            nonlocal hits, kana, worth
            span = m[0]
            high = sum(c >= "\x80" for c in span)
            if high < 4:
                return span
            table = byte_of("cp1252")
            raw = bytes(table[c] if c in table else ord(c) for c in span)
            try:
                found = raw.decode(encoding)
            except UnicodeDecodeError:
                return span
            value = east_asian(found)
            if value < 0.85 or len(found) > 0.75 * len(span) + 1:
                return span
            hits += len(span)
            kana += len(KANA.findall(found))
            worth += value * high
            return found

        new = legacy_spans(encoding).sub(decode, text)
        if not hits:
            continue
        japanese = kana > 0 or bool(KANA.search(text))
        worth *= 1.3 if japanese and encoding in ("cp932", "euc_jp") else 0.5 if not japanese and encoding == "cp932" else 0.9 if not japanese and encoding == "euc_jp" else 0.95 if encoding == "big5" else 1.0
        if worth > best[0] + 1e-9:
            best = (worth, new, hits)
    return best[1], best[2]


LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
# what is no letter of a Latin word, in a word: Greek, mathematics, box drawing, currency and the like
STRANGE = re.compile(f"(?<=[{LETTER}])[\u0370-\u045f\u2200-\u22ff\u2310-\u2321\u2500-\u259f\u00a1-\u00a6\u00a8\u00a9\u00ab-\u00b4\u00b6\u00b8\u00b9\u00bb-\u00bf\u00d7\u00f7\u2030\u201a\u201e\u207f\u20a7\u0192\u02c6\u02d8-\u02dd\ufb01\ufb02\u2020\u2021\u2026\u2022](?=[{LETTER}])|(?<![{LETTER}\u0370-\u045f])[\u0370-\u045f\u2200-\u22ff\u2310-\u2321\u2500-\u259f\u207f](?=[{LETTER}])|(?<=[{LETTER}])[\u0370-\u045f\u2310-\u2321\u2500-\u259f\u207f](?![{LETTER}\u0370-\u045f])")
# a capital inside a small word, or a lone accented letter that no language writes alone
CAPITAL = re.compile("(?<=[a-z])[\u00c0-\u00d6\u00d8-\u00de\u0152\u0160\u0178](?=[a-z])")
ALONE = re.compile("(?<=\\s)[\u00c0-\u00d6\u00d8-\u00df\u00e2-\u00e7\u00ea-\u00f2\u00f4-\u00f6\u00f8-\u00ff](?=\\s)")


# Greek, Cyrillic and frames: right beside one another, and in short symbols such as \u03c0r or \u0394t
GREEK = re.compile("[\u0370-\u045f\u2500-\u259f]")
WORD = re.compile(f"[{LETTER}]*")


def among(text: str, i: int) -> bool:
    """Whether the sign at place i stands among Greek, Cyrillic or frame signs that are no part of a Latin word."""
    a, b = i, i + 1
    while a > 0 and GREEK.match(text[a - 1]):
        a -= 1
    while b < len(text) and GREEK.match(text[b]):
        b += 1
    within = a > 0 and b < len(text) and LATIN.match(text[a - 1]) and LATIN.match(text[b])
    return b - a > 1 and not (within and b - a <= 3)


def belongs(text: str, i: int, new: str) -> bool:
    """Whether the letter, quotation mark or dash new would stand right at place i of text."""
    before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    inside = before.isalpha() and after.isalpha()
    if new == "\u2019":
        return inside
    if new in "\u2013\u2014":
        return not inside
    if not new.isalpha():
        return new in "\xbf\xa1\xab" and after.isalpha() or new == "\xbb" and before.isalpha()
    if new.islower():
        return True
    return not before.islower() and (not inside or after.isupper() or not before.isalpha())


def undo_western(text: str) -> tuple[str, int]:
    """Western bytes read in another one-byte encoding: signs that stand where no word has them become what
    they are in the encoding that fits most of them, and with them, where it belongs, what else that
    encoding has beside Latin letters. Signs that fit nothing stay."""
    misfits = [m for m in STRANGE.finditer(text) if not GREEK.match(m[0]) or len(WORD.match(text, m.end())[0]) + len(WORD.match(text[: m.start()][:-3:-1])[0]) > 1]
    misfits += [m for m in CAPITAL.finditer(text)] + [m for m in ALONE.finditer(text)]
    best: dict[int, str] = {}
    for encoding in ("cp437", "cp850", "mac_roman", "cp1250") if misfits else ():
        table = byte_of(encoding)
        western = {c: bytes([b]).decode("cp1252", "ignore") for c, b in table.items()}
        fits = {m.start(): western[m[0]] for m in misfits if western.get(m[0]) and western[m[0]] not in "\xbf\xa1\xab\xbb" and belongs(text, m.start(), western[m[0]])}
        if len(fits) > len(best):
            more = {i: western[c] for i, c in enumerate(text) if western.get(c) and not LATIN.match(c) and belongs(text, i, western[c]) and not among(text, i)}
            best = more | fits
    return "".join(best.get(i, c) for i, c in enumerate(text)) if best else text, len(best)


def repair(text: str) -> tuple[str, str, int]:
    """The repaired text, what was undone ("" if nothing), and the signs that remain lost.

    In each round the wrong decoding whose undoing covers most of the text is undone; text may have been
    garbled more than once.
    """
    if text.isascii():
        return text, "", 0
    undone: list[str] = []
    while True:  # every round makes the text shorter
        chars = {c for c in text if c >= "\x80"}
        tries = []
        if any_pair().search(text):
            for encoding in ONE_BYTE:
                leads, tails = leads_and_tails(encoding)
                if not leads.isdisjoint(chars) and not tails.isdisjoint(chars):
                    new, covered = undo_utf8(text, encoding)
                    if covered:
                        tries.append((covered, f"utf-8 as {encoding}", new))
        if LEGACY.search(text):
            new, covered = undo_legacy(text)
            if covered:
                tries.append((covered, "legacy as cp1252", new))
        if not tries:
            break
        best = max(tries, key=lambda t: t[0])
        undone.append(best[1])
        text = best[2]
    if any("\u2e80" <= c for c in chars):
        for encoding in TWO_BYTE:
            new, covered = undo_utf8_wide(text, encoding)
            if covered:
                undone.append(f"utf-8 as {encoding}")
                text = new
    if not undone:
        new, covered = undo_western(text)
        if covered:
            undone.append("cp1252 as another")
            text = new
    return text, ", ".join(dict.fromkeys(undone)), text.count(LOST)


def repair_encoding(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, repaired, undone, lost of every document that has wrongly decoded characters.

    lost counts signs that can't be restored (U+FFFD), whose bytes some decoding before had replaced; a
    document with nothing but those is reported with undone "", its text as it is. Null and empty texts, and ASCII texts (which never reach Python), have no rows.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).where(F.octet_length("body") != F.length("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for key, body in zip(batch["doc_id"], batch["body"]):
                fixed, undone, lost = repair(body)
                if undone or lost:
                    made.append((key, fixed, undone, lost))
            yield pd.DataFrame(made, columns=["doc_id", "repaired", "undone", "lost"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, repaired string, undone string, lost int").withColumnRenamed("doc_id", doc_id)

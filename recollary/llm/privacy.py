"""Personal information in free text: found, typed and replaced.

One scan of every text yields structured identifiers (e-mail addresses, phone numbers, identity numbers,
postal addresses) by their forms, and candidate names. Which candidates are names, and which other words
give persons away, is decided by information theory over the whole corpus: of every term it is counted how
often it stands in a protected context (an e-mail address's local part, a form's name field, an author
line, a title or honorific) and how often at all; terms whose pointwise mutual information with the
protected contexts, or whose share in them, exceeds the disclosure threshold reveal persons. Names made of
such terms are removed wherever they stand, in and out of those contexts; a lone word that reveals a person
by itself is generalised.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollary.session import cut

TYPES = ["email", "phone", "id_number", "address", "name"]
# a term with this share of its occurrences in protected contexts discloses persons whatever the base rate
SHARE = 0.3
# of Han and kana terms every occurrence in the corpus counts, not only candidates, so their share is less
WIDE_SHARE = 0.1
# a lone word with this share of all its occurrences in protected contexts is generalised
ALONE_SHARE = 0.5

# -- structured identifiers ----------------------------------------------------------------------

AT = r"(?:[ ]?@[ ]?|%40|[ ]?\[at\][ ]?|[ ]?\(at\)[ ]?|[ ]AT[ ])"
DOT = r"(?:\.|[ ]?\(dot\)[ ]?|[ ]?\[dot\][ ]?|[ ]DOT[ ])"
EMAIL = re.compile(rf"(?<![\w.+%-])([A-Za-z0-9][A-Za-z0-9._+-]*){AT}([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{DOT}[A-Za-z0-9-]+)*{DOT}[A-Za-z]{{2,}})(?![A-Za-z0-9])")
EMAIL_SIGN = re.compile(r"@|%40|\[at\]|\(at\)| AT ")
EMAIL_SPAN = 320  # an address is no longer: 64 signs, the @ and a domain of 253

# What introduces a person's number, by language.
ID_WORDS = (
    r"ssn|social security (?:number|no\.?)|passport (?:number|no\.?)|passport|national (?:id|insurance)(?: number| no\.?)?|tax (?:id|number)|id card"
    r"|steuer-?id(?:nummer|entifikationsnummer)?|steuernummer|ausweis(?:nummer|nr\.?)|personalausweis|reisepass(?:nummer)?|sozialversicherungsnummer"
    r"|num[ée]ro de s[ée]curit[ée] sociale|num[ée]ro fiscal|passeport(?: n[°º]\.?)?|nir|carte d'identit[ée]"
    r"|dni|nie|nif|cif|n[úu]mero de la seguridad social|pasaporte(?: n\.?[°º])?"
    r"|cpf|rg|nss|cart[ãa]o de cidad[ãa]o|passaporte(?: n\.?[°º])?|n[úu]mero de contribuinte|niss"
    r"|マイナンバー|個人番号|旅券番号|パスポート番号|免許証番号|基礎年金番号"
    r"|身份证(?:号码?|号)?|公民身份号码|护照(?:号码?|号)?|社保(?:卡)?号码?|社会保障号码?"
)
ID_LEAD = r"[\s\"']*(?i:number|no\.?|nr\.?|n\.?[°º]\.?|#|is|est|ist|es|é|为|是|は)?[\s\"']*[:=：＝]?[\s\"']*"
ID_NAMED = re.compile(rf"(?i:(?<![A-Za-z])(?:{ID_WORDS})){ID_LEAD}([A-Z]{{0,3}}[- ]?[0-9０-９](?:[-./ －]?[0-9０-９]){{1,17}}(?:-?[A-Z][0-9]{{0,6}})?)(?![A-Za-z0-9])")


def signs_of(words: str) -> tuple[tuple[str, ...], re.Pattern[str]]:
    """Necessary conditions of ID_NAMED in folded text: the longest part of each alternative that must stand
    as it is, and for those of up to three letters, which stand in other words too, a pattern of the word
    and the start of its number."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(words + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(words[at:i])
            at = i + 1
    fixed = [max(re.split(r"\(\?:[^()]*\)\??|\[[^]]*\]\??|\\?.\?", p), key=len) for p in parts]
    short = [w for w in fixed if w.isascii() and len(w) <= 3]
    # the first letter stands before the look behind, so that the search leaps to it
    start = "|".join(f"{w[0]}(?<![a-z]{w[0]}){w[1:]}" for w in short)
    return tuple(dict.fromkeys(w for w in fixed if w not in short)), re.compile(rf"(?:{start}){ID_LEAD}[a-z]{{0,3}}[- ]?[0-9０-９]")


ID_SIGNS, ID_SIGNS_SHORT = signs_of(ID_WORDS)


def folded(text: str) -> str:
    """Small letters, by the rules of a pattern that ignores case."""
    return text.lower() if text.isascii() else text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()


ID_SHAPES = re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]\d{7}-?[A-Z]|\d{17}[\dX])(?![\w-]|\.\d)")

DIGITS = re.compile(r"(?<![\w.,:=/%#$€£@-])[+＋(（]{0,2}[0-9０-９](?:[ ().\-/－（） ‑]{0,2}[0-9０-９]){6,16}(?![\w%@]|[.,:/-]\d)|(?<=[=:])[+＋]?[(（]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,16}(?![\w%@]|[.,:/-]\d)")
# Lengths of the digit groups of national phone numbers, and their first digits.
PHONE_SHAPES = {
    (3, 3, 4): "2-9", (1, 3, 3, 4): "1", (3, 4, 4): "01", (4, 3, 4): "0", (4, 4, 4): None, (5, 6): "0", (5, 3, 3): "0", (4, 6): "0", (4, 7): "0",
    (2, 2, 2, 2, 2): "0", (2, 3, 2, 2): "5-9", (3, 2, 2, 2): "5-9", (3, 3, 3): "2-9", (2, 4, 4): "0-9", (2, 5, 4): "1-9", (2, 3, 4): "2-9",
    (3, 5, 3): "0", (3, 8): "01", (3, 7): "0", (3, 6): "0", (4, 5, 3): "0", (3, 4, 3): "0", (3, 5, 4): "0", (2, 8): "0", (4, 8): "0",
}


def is_phone(found: str) -> bool:
    """Whether a run of digits and separators has the form of a phone number."""
    plain = unicodedata.normalize("NFKC", found).replace("‑", "-")
    groups = [len(g) for g in re.findall(r"\d+", plain)]
    digits = re.sub(r"\D", "", plain)
    if plain.lstrip("(").startswith("+"):
        return 8 <= len(digits) <= 15
    if plain.count("(") != plain.count(")"):
        return False
    if len(groups) == 1:  # a bare number is a phone number only with its trunk prefix, never a count
        return False
    first = PHONE_SHAPES.get(tuple(groups))
    if first is None or not re.match(f"[{first}]", digits):
        return False
    seps = set(re.findall(r"[^\d()\s]", plain))
    if len(seps) > 1 or (tuple(groups) == (2, 4, 4) and not (plain.startswith("(") or digits[0] == "0")):
        return False
    return not (tuple(groups) == (3, 3, 4) and digits[:3] == "000")


# Words for streets, by language.
STREET_EN = r"(?:Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Court|Ct\.?|Street|St\.?|Drive|Dr\.?|Way|Place|Pl\.?|Square|Sq\.?|Terrace|Close|Crescent|Highway|Hwy\.?|Parkway|Pkwy\.?|Row|Walk|Gardens|Mews)"
ZIP_DE = re.compile(r"\d[ ]?[a-z]?,?\s(?:D-)?\d{5}[ ][A-ZÄÖÜ]")
# each pattern with words (or a quick pattern) of which one must stand in the text: what it can't match without
ADDRESSES = [
    (
        ("Road", "Rd", "Lane", "Ln", "Ave", "Blvd", "Boulevard", "Court", "Ct", "Street", " St", "Drive", " Dr", "Way", "Place", " Pl", "Square", "Sq", "Terrace", "Close", "Crescent", "Highway", "Hwy", "Parkway", "Pkwy", " Row", "Walk", "Gardens", "Mews"),
        rf"(?:(?<![A-Za-z])(?:Flat|Apt\.?|Unit|Suite)[ ]\w+,[ ])?(?<![\w.-])\d{{1,5}}[A-Za-z]?[ ](?:[A-Z][\w'’]+[ ]){{1,4}}{STREET_EN}(?![\w])(?:,?\s(?:Apt\.?|Flat|Unit|Suite)[ ]\w+)?(?:,?\s[A-Z][\w]+(?:[ ][A-Z][\w]+)*)?(?:,?[ ][A-Z]{{1,2}}\w?[ ]?\d\w{{1,4}}(?:[ ]\d[A-Z]{{2}})?)?",
    ),
    (
        ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "impasse ", "quai ", "allée ", "route ", "cours ", "square "),
        r"(?<!\w)\d{1,4}(?:[ ](?:bis|ter))?,?[ ](?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|route|cours|square)[ ](?:d[eu]s?[ ]|de[ ]la[ ]|de[ ]l['’]|d['’]|l['’])?[A-ZÀ-Þ][\w'’-]+(?:[ ][\w'’-]+){0,4}(?:,\s\d{5}[ ][A-ZÀ-Þ][\w-]+)?",
    ),
    (
        ("Calle", "C/", "Avenida", "Avda", "Plaza", "Paseo", "Camino", "Ronda", "Travesía", "Carrera"),
        r"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Travesía|Carrera)[ ](?:de[ ]los[ ]|de[ ]las[ ]|de[ ]la[ ]|de[ ]|del[ ])?[A-ZÀ-Þ][\w'’-]+(?:[ ][\w'’-]+){0,4}?,?[ ](?:n\.?[ºo°]?[ ])?\d{1,4}(?:,[ ]\d+\.?[ºª°][ ]?\w*)?(?:,\s\d{5}[ ][A-ZÀ-Þ][\w-]+)?",
    ),
    (
        ("Rua", "R. ", "Avenida", "Av.", "Travessa", "Praça", "Largo", "Alameda", "Estrada"),
        r"(?<!\w)(?:Rua|R\.|Avenida|Av\.|Travessa|Praça|Largo|Alameda|Estrada)[ ](?:d[aoe]s?[ ])?[A-ZÀ-Þ][\w'’-]+(?:[ ][\w'’-]+){0,4}?,?[ ](?:n\.?[ºo°][ ])?\d{1,4}(?:,[ ][^\n|,\"]{1,20})?(?:,\s\d{4,5}-\d{3}[ ][A-ZÀ-Þ][\w-]+(?:[ ][A-ZÀ-Þ][\w-]+)*)?",
    ),
    (
        ("straße", "strasse", ZIP_DE),
        r"(?<!\w)(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm|steig|hof)|(?:Am|An|Auf|Im|In|Zum|Zur|Unter|Hinter)(?:[ ](?:der|dem|den))?[ ][A-ZÄÖÜ][\wäöüß-]+)[ ]\d{1,4}[ ]?[a-z]?,?\s(?:D-)?\d{5}[ ][A-ZÄÖÜ][\wäöüß-]+|(?<!\w)[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse)[ ]\d{1,4}",
    ),
    (
        (re.compile(r"[都道府県][一-鿿ぁ-んァ-ヶ]{1,8}?[市区町村郡][一-鿿ぁ-んァ-ヶ]{0,10}[0-9０-９一二三四五六七八九十]"),),
        r"(?:〒?\d{3}-\d{4}\s?)?[一-鿿]{1,3}[都道府県][一-鿿ぁ-んァ-ヶ]{1,8}?[市区町村郡][一-鿿ぁ-んァ-ヶ]{0,10}[0-9０-９一二三四五六七八九十]+(?:丁目|番地?|号|[-－])(?:[0-9０-９一二三四五六七八九十]+(?:番地?|号|[-－])?)*",
    ),
    (
        ("号",),
        r"(?:[一-鿿]{1,4}(?:省|自治区))?[一-鿿]{1,6}(?:市|区|县|州)[一-鿿]{1,10}(?:路|街|道|巷|弄|胡同)[0-9０-９]+号(?:[0-9０-９]+(?:室|栋|单元|楼))*",
    ),
]
ADDRESSES = [(signs, re.compile(pattern)) for signs, pattern in ADDRESSES]

# -- names ----------------------------------------------------------------------------------------

CAP = r"[A-ZÀ-Þ](?:[a-zß-ÿ'’]+(?:-?[A-ZÀ-Þ][a-zß-ÿ]+)?|[A-ZÀ-Þ'’-]+)"
PARTICLE = r"(?:(?:d[aeio]s?|du|del|de la|de los|van|von|van der|van den|zu|ter|ten|la|le|y|e|bin|al)[ ])"
PAIR = re.compile(rf"(?<![\w@.+-])({CAP})(?=(,?[ \t  　\n]{{1,2}}(?:[A-Z]\.[ \t  　\n]{{1,2}}|{PARTICLE})?)({CAP})(?![\w@+]))")
# contexts that make what follows a person's name
BEFORE = re.compile(r"(?:\"(?:full_?name|name|ne|author|owner|contact)\"\s*:\s*\"|\bAuthor:\s|\breviewed-by:\s|\bassignee=|\bowner=|\bDr\.\s|\bMrs?\.\s|\bMs\.\s|\bProf\.\s|\bHerr\s|\bFrau\s|\bSra?\.\s|\bMme\s)$")
HAN = r"[一-鿿々]"
NAME_JA = re.compile(r"(?:前に|は先週|先週|担当者?[はの])([一-鿿々][一-鿿々ヶケノ之]{1,3})([ 　]?)([一-鿿々ぁ-んァ-ヶー]{2,4}?)(?=さん|様|氏|が(?:書き|作成し|担当し|更新し)ました)")
NAME_ZH = re.compile(r"(?:由|先问|请问|联系|询问|咨询|告诉)([一-鿿]{2,4}?)(?=写的|写成|负责|[。，！,\s]|先生|女士)")
# a cell, value or line that is nothing but a short Han or kana string
ALONE = re.compile(r"(?:(?<=[\n|\":：=;])|^)[ ]?([一-鿿々][一-鿿々ヶノ]{0,3}[ 　]?(?:[一-鿿々]{1,4}|[一-鿿々]{0,3}[ぁ-んァ-ヶ]{1,4}))[ ]?(?=[\n|\",;]|$)")
WIDE = re.compile(r"[一-鿿]")


def cjk_terms(name: str) -> list[str]:
    """Leading parts that may be the surname."""
    bare = re.sub(r"[ 　]", "", name)
    return [f"^{bare[:n]}" for n in (2, 3) if len(bare) > n]


def scan(text: str) -> list[tuple[str, int, int, list[str], bool]]:
    """(type, start, end, terms, protected): identifiers, and "name?" candidates with their terms.

    Terms of an e-mail address are the words of its local part. protected marks terms that stand in a
    protected context.
    """
    found: list[tuple[str, int, int, list[str], bool]] = []
    taken: list[tuple[int, int]] = []
    for sign in EMAIL_SIGN.finditer(text):
        for m in EMAIL.finditer(text, max(0, sign.start() - EMAIL_SPAN), sign.end() + EMAIL_SPAN):
            if not m.start() < sign.start() < m.end() or m.span() in taken or " AT " in m[0] and " DOT " not in m[0] or len(m[1]) > 64 or len(m[2]) > 253:
                continue
            words = [w for w in re.split(r"[._\d-]+", m[1].partition("+")[0].lower()) if len(w) > 2]
            found.append(("email", m.start(), m.end(), words, True))
            taken.append(m.span())
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    small = folded(text)
    named = any(s in small for s in ID_SIGNS) or ID_SIGNS_SHORT.search(small)
    for m in ID_NAMED.finditer(text) if named else ():
        if sum(c.isdigit() for c in m[1]) >= 5:
            found.append(("id_number", m.start(), m.end(), [], False))
            taken.append(m.span())
    for m in ID_SHAPES.finditer(text):
        if free(*m.span()):
            found.append(("id_number", m.start(), m.end(), [], False))
            taken.append(m.span())
    for m in DIGITS.finditer(text):
        if free(*m.span()) and is_phone(m[0]):
            found.append(("phone", m.start(), m.end(), [], False))
            taken.append(m.span())
    for signs, pattern in ADDRESSES:
        if any(s in text if isinstance(s, str) else s.search(text) for s in signs):
            for m in pattern.finditer(text):
                found.append(("address", m.start(), m.end(), [], False))
                taken.append(m.span())
    for m in PAIR.finditer(text):
        end = m.end() + len(m[2]) + len(m[3])
        if "\n\n" in m[2] or not free(m.start(), end):
            continue
        a, b = m[1].lower(), m[3].lower()
        safe = bool(BEFORE.search(text, max(0, m.start() - 24), m.start())) if m.start() else False
        found.append(("name?", m.start(), end, [a, b], safe))
    if WIDE.search(text):
        for m in NAME_JA.finditer(text):
            found.append(("name?", m.start(1), m.end(3), cjk_terms(m[1] + m[3]), True))
        for m in NAME_ZH.finditer(text):
            found.append(("name?", m.start(1), m.end(1), cjk_terms(m[1]), True))
        for m in ALONE.finditer(text):
            found.append(("name?", m.start(1), m.end(1), cjk_terms(m[1]), False))
    return found


SPANS = "type string, start int, stop int, terms array<string>, protected boolean"


def candidates(items: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys and type, start, stop, terms, protected of everything that scan finds."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = items.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("body")).where(F.length("body") > 0)
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(*row[:-1], *f) for row in batch.itertuples(index=False, name=None) for f in scan(row[-1])]
            yield pd.DataFrame(made, columns=[*names, "type", "start", "stop", "terms", "protected"])

    return rows.mapInPandas(run, f"{kinds}, {SPANS}").select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "type", "start", "stop", "terms", "protected")


RUNS = r"[\u4e00-\u9fff々ヶノ]{2,}"


def wide_terms(items: DataFrame, keys: list[str], text: str, wanted: DataFrame) -> DataFrame:
    """The keys, term, n of the wanted terms (^ and two or three signs) in each text, wherever they stand in it."""
    runs = items.where(F.col(text).rlike("[\u4e00-\u9fff]")).select(*keys, F.explode(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))).alias("run"))
    part = lambda size: F.transform(F.sequence(F.lit(1), F.length("run") - (size - 1)), lambda i: F.substring(F.col("run"), i, F.lit(size)))
    parts = F.when(F.length("run") > 2, F.concat(part(2), part(3))).otherwise(F.array("run"))
    bare = wanted.select(F.substring("term", 2, 3).alias("part"))
    return runs.select(*keys, F.explode(parts).alias("part")).join(bare, "part").groupBy(*keys, F.concat(F.lit("^"), "part").alias("term")).agg(F.count("*").alias("n"))


def names_of_terms(text: str, terms: list[str], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of full names that begin with one of the terms (Han or kana surnames), outside the taken spans."""
    found = []
    for term in sorted(terms, key=len, reverse=True):
        for m in re.finditer(rf"{re.escape(term[1:])}(?:[一-鿿々]{{1,{5 - len(term[1:])}}}|[ 　][一-鿿々ぁ-んァ-ヶ]{{1,3}})", text):
            if all(m.end() <= a or m.start() >= b for a, b in (*taken, *found)):
                found.append(m.span())
    return found


def disclosure(found: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """term, bits, share: pointwise mutual information of each term with the protected contexts, and the share
    of its occurrences that are in one.

    Counted over the whole corpus, each occurrence once; smoothing is added to the counts."""
    seen = found.where("type in ('name?', 'email')").select("protected", F.explode("terms").alias("term"))
    counts = seen.groupBy("term").agg(F.count("*").alias("n"), F.sum(F.col("protected").cast("long")).alias("c"))
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("c").alias("all_c"))
    share = F.col("c") / (F.col("n") + smoothing)
    base = (F.col("all_c") + smoothing) / (F.col("all_n") + smoothing)
    return counts.crossJoin(F.broadcast(total)).where("c > 0").select("term", F.log2(share / base).alias("bits"), share.alias("share"))


def personal_information(items: DataFrame, keys: list[str], text: str = "content", threshold: float = 0.0) -> DataFrame:
    """The keys, type, start, stop of each span of personal information; start and stop in code points.

    A candidate name is one if all its terms disclose more than threshold bits about protected contexts, or
    stand in one at least three times in ten, which decides where nearly all of a small corpus is protected.
    Han and kana names have no capitals that make candidates: a leading part of a name in a protected
    context that is in one in a tenth of all its occurrences in the corpus is a surname, and a name begins
    wherever it stands. Rows of equal keys give equal spans once. Null, empty texts and texts without finds
    have no rows. Spans of different types may overlap.
    """
    found = cut(candidates(items, keys, text).distinct())
    return spans_of(found, items, keys, text, threshold)


def spans_of(found: DataFrame, items: DataFrame, keys: list[str], text: str, threshold: float) -> DataFrame:
    names = [f"k{i}" for i in range(len(keys))]
    bits = disclosure(found)
    narrow = bits.where(~F.col("term").startswith("^") & ((F.col("bits") > threshold) | (F.col("share") >= SHARE))).select("term")
    sure = found.where("type <> 'name?'").select(*keys, "type", "start", "stop")
    open_names = found.where("type = 'name?'").select(*keys, "start", "stop", F.col("terms").alias("t"), F.explode("terms").alias("term"))
    telling = open_names.join(narrow, "term").groupBy(*keys, "start", "stop", "t").agg(F.count("*").alias("n"))
    western = telling.where(F.col("n") >= F.size(F.array_distinct("t"))).select(*keys, F.lit("name").alias("type"), "start", "stop")
    # Han and kana: every occurrence of the terms of protected names is counted, then looked up in its text
    texts = items.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("body")).where("body is not null").distinct()
    stated = found.where("type = 'name?' and protected").select(F.explode("terms").alias("term")).where(F.col("term").startswith("^")).groupBy("term").agg(F.count("*").alias("c"))
    held = cut(wide_terms(texts, names, "body", stated))
    counted = held.groupBy("term").agg(F.sum("n").alias("n"))
    surnames = stated.join(counted, "term", "left").where(F.col("c") / (F.greatest(F.coalesce("n", F.lit(0)), F.col("c")) + 1) >= WIDE_SHARE).select("term")
    wide = open_names.where(F.col("term").startswith("^")).join(surnames, "term").select(*keys, F.lit("name").alias("type"), "start", "stop")
    asked = held.join(surnames, "term", "left_semi").groupBy(*names).agg(F.collect_set("term").alias("terms"))
    blocked = found.where("type = 'address'").groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.collect_set(F.struct("start", "stop")).alias("taken"))
    kinds = ", ".join(f"{n} {texts.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False, name=None):
                taken = [(s["start"], s["stop"]) for s in (row[-1] if row[-1] is not None else [])]
                made += [(*row[: len(names)], a, b) for a, b in names_of_terms(row[-3], list(row[-2]), taken)]
            yield pd.DataFrame(made, columns=[*names, "start", "stop"])

    looked = texts.join(asked, names).join(blocked, names, "left").select(*names, "body", "terms", "taken").mapInPandas(run, f"{kinds}, start int, stop int")
    anywhere = looked.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.lit("name").alias("type"), "start", "stop")
    return sure.unionByName(western).unionByName(wide).unionByName(anywhere).distinct()


def lone_terms(found: DataFrame, items: DataFrame, keys: list[str], text: str, share: float = ALONE_SHARE) -> DataFrame:
    """The keys, lone: the words of each text that give a person away by themselves: those that are in a protected
    context in at least that share of all their occurrences in the corpus, whatever their case, and twice at least."""
    terms = found.where("type in ('name?', 'email')").select("protected", F.explode("terms").alias("term")).where(~F.col("term").startswith("^"))
    stated = terms.groupBy("term").agg(F.count_if("protected").alias("c")).where("c > 1")
    words = items.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("term"))
    held = words.join(stated.select("term"), "term", "left_semi").groupBy(*keys, "term").agg(F.count("*").alias("n"))
    counted = held.groupBy("term").agg(F.sum("n").alias("n")).join(stated, "term").where(F.col("c") / (F.col("n") + 1) >= share).select("term")
    return held.join(counted, "term", "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_set("term")).alias("lone"))


def redact(items: DataFrame, keys: list[str], text: str = "content", threshold: float = 0.0) -> DataFrame:
    """The keys, redacted, found (sorted types), generalised (words) of every row.

    Overlapping spans become one placeholder, [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME]; a lone word
    that gives a person away (see lone_terms) becomes the more general [PERSON]. Rows without finds keep
    their text; null texts stay null. keys must identify a text.
    """
    found = cut(candidates(items, keys, text).distinct())
    spans = spans_of(found, items, keys, text, threshold).groupBy(*keys).agg(F.collect_list(F.struct("start", "stop", "type")).alias("spans"))
    lone = lone_terms(found, items, keys, text)
    rows = items.select(*keys, F.col(text).alias("body")).dropDuplicates(keys).join(spans, keys, "left").join(lone, keys, "left")

    @F.pandas_udf("string")
    def replace(bodies: pd.Series, all_spans: pd.Series, all_lone: pd.Series) -> pd.Series:
        made = []
        for body, spans, lone in zip(bodies, all_spans, all_lone):
            if body is None:
                made.append(body)
                continue
            words = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, lone)) + r")(?!\w)", re.IGNORECASE) if lone is not None and len(lone) else None
            general = lambda part: words.sub("[PERSON]", part) if words else part
            parts, at = [], 0
            for s in sorted(spans if spans is not None else [], key=lambda s: (s["start"], -s["stop"])):
                if s["start"] >= at:
                    parts += [general(body[at : s["start"]]), f"[{s['type'].upper()}]"]
                at = max(at, s["stop"])
            made.append("".join(parts) + general(body[at:]))
        return pd.Series(made)

    types = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["type"])))
    none = F.array().cast("array<string>")
    return rows.select(*keys, replace("body", "spans", "lone").alias("redacted"), F.coalesce(types, none).alias("found"), F.coalesce("lone", none).alias("generalised"))

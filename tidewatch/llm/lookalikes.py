"""Visually identical text in one form.

Two steps. ``fold`` brings one text to one form of each character: canonical composition,
wide, narrow, joined and font forms as the plain letters, every blank as a blank, hyphens
as the hyphen, invisible characters removed. Signs that a reader tells apart (superscript
and circled digits, fractions, long dashes, accents, case) stay.

Then script-aware repair: each token that mixes scripts, or consists of look-alikes only
and stands in a text of another script, is suspicious. Its dominant script comes from the
letters that have no look-alike (else from the text's own); look-alikes are substituted
towards that script when the result exists in the corpus vocabulary, that is as a token
that is not suspicious, or as the repaired form of another text's token.

Only texts with characters beyond ASCII go through Python (Arrow batches); the vocabulary is
looked up for the few candidate forms by equi joins, so nothing of corpus size is collected,
broadcast or held in one task. The forms are broadcast only where their measured size is below
BROADCAST_BYTES: then other tokens are dropped before they are exchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut

# Letters of other scripts with the Latin letter they look like (Unicode's confusable
# characters, restricted to pairs that print alike).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХаеѕіјорсухһӏԁԛԝѵ", "ABESIJKMHOPCTXaesijopcyxhldqwv", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳ", "ABEZHIKMNOPTYXovpcj", strict=True))
ARMENIAN = dict(zip("օսհցԼՕՍ", "ouhgLOU", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCEHJKLMPRSTVWZ", strict=True))
LATIN_VARIANTS = {"ɡ": "g", "ı": "ı", "ſ": "ſ", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m"}
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz"}
HYPHENS = "‐‑‒–−˗⁃֊᐀᠆⸗﹣﹘－Ⲻ"
#: Invisible characters: soft hyphen, joiners, marks of direction, word joiner, byte order mark, selectors, fillers.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFEFF, 0xFFA0, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0xE0000, 0xE0080)]
_PLAIN_FORMS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


def _fold_table() -> dict[int, str | None]:
    t: dict[int, str | None] = {}
    for cp in range(0x80, 0x20000):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d.startswith(_PLAIN_FORMS):
            t[cp] = unicodedata.normalize("NFKC", ch)
        elif unicodedata.category(ch) == "Zs":
            t[cp] = " "
    t |= {ord(k): v for k, v in (LATIN_VARIANTS | JOINED).items()}
    t |= {ord(h): "-" for h in HYPHENS}
    t |= dict.fromkeys(INVISIBLE)
    t |= {0x09: " ", 0x0B: " ", 0x0C: " ", 0x85: "\n", 0x2028: "\n", 0x2029: "\n"}
    return t


_FOLD = _fold_table()


def fold(text: str) -> str:
    """One form of each character, without look-alike substitution."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).translate(_FOLD))


_TO_LATIN = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE}
SCRIPTS = ("latin", "cyrillic", "greek")
#: script -> (any look-alike letter -> this script's letter of the same look)
_TOWARDS = {
    "latin": {**_TO_LATIN},
    "cyrillic": {v: k for k, v in CYRILLIC.items()},
    "greek": {v: k for k, v in GREEK.items()},
}
for _s in ("cyrillic", "greek"):
    _TOWARDS[_s] |= {k: _TOWARDS[_s][v] for k, v in _TO_LATIN.items() if v in _TOWARDS[_s] and k != _TOWARDS[_s][v]}
_AMBIGUOUS = set(_TO_LATIN) | set(_TO_LATIN.values())
_TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯ][^\W_]*)*")
TOKEN_PATTERN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def script_of(ch: str) -> str | None:
    """Script of a letter, None for anything else."""
    o = ord(ch)
    if not ch.isalpha():
        return None
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0x250 <= o < 0x2B0:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 or 0x2DE0 <= o < 0x2E00 or 0xA640 <= o < 0xA6A0:
        return "cyrillic"
    return "other"


def text_script(folded: str) -> str:
    """Script with most letters that have no look-alike; Latin if there is none."""
    n = dict.fromkeys(SCRIPTS, 0)
    for ch in set(unicodedata.normalize("NFD", folded)):
        if ch not in _AMBIGUOUS and (s := script_of(ch)) in n:
            n[s] += folded.count(ch)
    return max(SCRIPTS, key=lambda s: n[s])


def towards(token: str, script: str) -> str | None:
    """The token with all look-alikes in ``script``; None if a letter has none there."""
    out = []
    for ch in unicodedata.normalize("NFD", token):
        s = script_of(ch)
        if s is not None and s != script:
            if (ch := _TOWARDS[script].get(ch)) is None:
                return None
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def candidates(token: str, own: str) -> list[str]:
    """Forms to try for a token of a text in script ``own``, in this order; empty if the token is not suspicious."""
    letters = [c for c in unicodedata.normalize("NFD", token) if script_of(c) is not None]
    scripts = {script_of(c) for c in letters}
    sure = {script_of(c) for c in letters if c not in _AMBIGUOUS}
    if len(scripts) < 2 and (sure or not scripts or scripts == {own}):
        return []
    order = [s for s in SCRIPTS if s in sure] if sure else [own, *[s for s in SCRIPTS if s != own]]
    if len(sure) > 1:
        return []
    return list(dict.fromkeys(f for s in order if (f := towards(token, s)) is not None))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, forms, sus = [], [], []
        for i, text in zip(b["doc_id"], b["text"]):
            f = fold(text)
            own = text_script(f)
            tokens = {t for t in _TOKEN.findall(f) if not t.isascii() or (own != "latin" and any(c in _AMBIGUOUS for c in t))}
            ids.append(i)
            forms.append(f)
            sus.append([{"token": t, "forms": c} for t in sorted(tokens) if (c := candidates(t, own))])
        yield pd.DataFrame({"doc_id": ids, "form": forms, "suspicious": sus})


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for f, repairs in zip(b["form"], b["repairs"]):
            if repairs is not None and len(repairs):
                m = {r["token"]: r["form"] for r in repairs}
                f = _TOKEN.sub(lambda t, m=m: m.get(t[0], t[0]), f)
            out.append(f)
        yield pd.DataFrame({"doc_id": b["doc_id"], "form": out})


#: Largest total length of the forms asked for that is broadcast.
BROADCAST_BYTES = 16 << 20
#: Copies of one text that a join task meets; a text with more is split.
COPIES_A_TASK = 50_000
_BEYOND_ASCII = r"[^\x00-\x7f]"


def _ascii_form(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\r\n?", "\n"), "\t\x0b\x0c", "   ")


def normalized(documents: DataFrame) -> DataFrame:
    """doc_id, form: every non-null text in one form; an empty text stays empty.

    Null texts and rows without doc_id are left out. Repeated rows come out as often as they
    stand. Texts of any length are processed whole.
    """
    docs = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    plain = docs.filter(~F.col("text").rlike(_BEYOND_ASCII)).select("doc_id", _ascii_form(F.col("text")).alias("form"))
    scanned = cut(docs.filter(F.col("text").rlike(_BEYOND_ASCII)).mapInPandas(_scan, "doc_id long, form string, suspicious array<struct<token: string, forms: array<string>>>"))

    tries = scanned.select("doc_id", F.explode("suspicious").alias("s")).distinct().select("doc_id", "s.token", F.posexplode("s.forms").alias("choice", "form"))
    wanted = tries.select("form").distinct()
    size = wanted.agg(F.sum(F.octet_length("form") + 32).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    # Vocabulary: tokens that are not suspicious where they stand, and what other texts' suspicious tokens become.
    words = plain.unionByName(scanned.select("doc_id", "form")).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("form", F.lit(TOKEN_PATTERN), 0))).alias("form"))
    clean = words.join(wanted, "form", "left_semi").join(tries.select("doc_id", F.col("token").alias("form")).distinct(), ["doc_id", "form"], "left_anti")
    clean = clean.groupBy("form").agg(F.lit(True).alias("clean"))
    shared = tries.groupBy("form").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter(F.col("lo") < F.col("hi")).select("form", F.lit(True).alias("shared"))
    known = tries.join(clean, "form", "left").join(shared, "form", "left").filter(F.col("clean") | F.col("shared"))
    best = F.min(F.struct(F.coalesce(~F.col("clean"), F.lit(True)).alias("unclean"), "choice", "form"))
    repairs = known.groupBy("doc_id", "token").agg(best.alias("b")).groupBy("doc_id").agg(F.collect_list(F.struct("token", F.col("b.form").alias("form"))).alias("repairs"))
    repaired = scanned.select("doc_id", "form").join(repairs, "doc_id", "left").mapInPandas(_apply, "doc_id long, form string")
    return plain.unionByName(repaired)


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_id: documents with a non-empty text; equal class_id means one look."""
    docs = documents.select("doc_id", F.sha2("text", 256).alias("text_hash")).filter((F.col("text") != "") & F.col("doc_id").isNotNull())
    form = normalized(documents).select("doc_id", F.sha2("form", 256).alias("class_id"))
    return docs.join(form, "doc_id")


def found(documents: DataFrame) -> DataFrame:
    """The rows of TESTDATA.md's p9_found: pairs of different texts of one form.

    Pairs are formed of distinct texts first (a class has as many as it has spellings) and then
    joined with the documents of either text, so copies never meet their own copies. A text with
    more than COPIES_A_TASK copies is split into parts, each of which meets all partners.
    """
    c = cut(classes(documents).distinct())
    texts = c.groupBy("class_id", "text_hash").agg(F.ceil(F.count("*") / COPIES_A_TASK).cast("int").alias("parts"))
    several = texts.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1").select("class_id")
    texts = texts.join(several, "class_id")
    a = texts.select("class_id", F.col("text_hash").alias("hash_a"))
    b = texts.select("class_id", F.col("text_hash").alias("hash_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = a.join(b, "class_id").filter(F.col("hash_a") < F.col("hash_b")).drop("class_id")
    # Documents of texts that have a look-alike, with the part of their text they belong to.
    docs = c.join(texts.select("text_hash", "parts"), "text_hash").select("doc_id", "text_hash", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    one = docs.select(F.col("text_hash").alias("hash_a"), F.col("doc_id").alias("x"))
    two = docs.select(F.col("text_hash").alias("hash_b"), "part", F.col("doc_id").alias("y"))
    hit = pairs.join(one, "hash_a").join(two, ["hash_b", "part"])
    return hit.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

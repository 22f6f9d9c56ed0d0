"""Garbled text from wrong decoding: garbled forms of every distinct clean corpus word under all chains, joined with the tokens."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from noticeforge.sources.tables import materialized

#: Chains of (encoded as, decoded as). A second pair garbles the result of the first once more.
ONE_BYTE = ("latin-1", "cp1252", "mac_roman", "cp437")
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", d),) for d in ONE_BYTE),
    *((("utf-8", d), ("utf-8", d)) for d in ("latin-1", "cp1252", "mac_roman")),
    *((("cp949", d),) for d in ONE_BYTE),
    *((("gbk", d),) for d in ("latin-1", "cp1252")),
    *((("cp932", d),) for d in ("latin-1", "cp1252")),
    *((("utf-8", d),) for d in ("cp949", "cp932", "gb18030")),
    (("cp949", "cp932"),), (("cp949", "utf-8"),), (("cp932", "utf-8"),), (("gbk", "utf-8"),), (("cp1252", "utf-8"),),
    (("cp949", "gbk"),), (("cp949", "big5"),),
)
#: A token is a run of characters outside ASCII: ASCII stands still under every chain, so it bounds both words and forms.
RUN = r"[^\x00-\x7f]+"
#: Clean runs are of one script; Latin letters with marks stand one or two together in clean words.
_SCRIPTS = r"\p{Hangul}+|[\p{Han}\p{Hiragana}\p{Katakana}ー]+|\p{Thai}+|\p{Devanagari}+|\p{Arabic}+|\p{Greek}+|\p{Cyrillic}+"
_MARKS = r"[\p{Z}“”‘’…·•※▶■○●◆◇□△▲▼★☆♬①-⑳、。，．：；！？「」『』【】《》（）［］～・।،؛؟–—°℃′″€₩]"
_CLEAN = regex.compile(rf"(?:{_SCRIPTS}|\p{{Latin}}\p{{Latin}}?|{_MARKS})+")
_SPLIT = regex.compile(rf"{_MARKS}+")
_ONE_SCRIPT = regex.compile(rf"{_SCRIPTS}|\p{{Latin}}\p{{Latin}}?")
#: The same for the JVM: a token that is clean in this sense is garbled only if a whole word of it is a form of another word.
#: Only classes repeat, never groups, which would overflow its stack on a very long token.
_PLAIN = "|".join(rf"^[{script}“”‘’…·•※▶■○、。，：；！？「」『』【】（）～]+$" for script in (r"\x{ac00}-\x{d7a3}", r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー")) + r"|^\p{IsThai}+$|^\p{IsDevanagari}+।?$|^\p{IsArabic}+$"
LOST = "�"
#: Characters from which a token that is a form of another word is no chance, and how many times as many records as its original
#: it may stand in then. A shorter one counts only if its original stands in as many records (a clean-looking one: in more), so
#: that one odd word makes nothing garbled.
LONG, LEAD = 4, 10
#: How many times as many records as a pair of signs a syllable must stand in alone to be its original.
SURE = 4
#: Distinct letters outside ASCII that may count as clean: more than scripts of living languages have.
MAX_LETTERS = 60_000


def _one_byte_table(codec: str) -> str:
    """The characters of a codec's 256 bytes; undefined ones come out as the control character of their number, as browsers do it."""
    return "".join(chr(b) if (c := bytes([b]).decode(codec, "replace")) == LOST else c for b in range(256))


#: The chains that end in a decoder of several bytes: only these can give words of one script. A clean word read as UTF-8 without
#: loss is the original of its own garbled form, so those that end in UTF-8 give none.
_WIDE = [n for n, chain in enumerate(CHAINS) if chain[-1][1] not in (*ONE_BYTE, "utf-8")]
_TABLES = {c: _one_byte_table(c) for c in ONE_BYTE}
#: Chains of national code pages read byte by byte: one syllable becomes two signs, as many clean pairs of signs look.
_PAIRS = [n for n, chain in enumerate(CHAINS) if chain[0][0] in ("cp949", "gbk", "cp932") and chain[0][1] in ONE_BYTE]
#: Words of three or more Latin letters with marks: never taken for clean, as garbled text looks so, but their forms are looked up.
_LATIN = r"^\p{IsLatin}{3,}$"


def garble(words: list[str], chain: tuple[tuple[str, str], ...]) -> list[str]:
    """Each word after the (encoded as, decoded as) pairs of chain; a word that can't be encoded comes out with a '?'."""
    # Blanks stand for what follows a word in a text: decoders of several bytes look up to three ahead.
    text = "\n".join(words) + "\n" * 4
    for encoded, decoded in chain:
        raw = text.encode(encoded, "replace")
        text = codecs.charmap_decode(raw, "strict", _TABLES[decoded])[0] if decoded in _TABLES else raw.decode(decoded, "replace")
    out = text.split("\n")[:-4]
    # If a broken word has swallowed its blank, word by word.
    return out if len(out) == len(words) else [garble([w], chain)[0] for w in words] if len(words) > 1 else [text.replace("\n", "")]


def clean_words(run: str) -> list[str]:
    """The clean words of a run: its parts of one script between marks; none if anything in it is not clean."""
    if not _CLEAN.fullmatch(run):
        return []
    parts = [p for p in _SPLIT.split(run) if p]
    return parts if all(_ONE_SCRIPT.fullmatch(p) for p in parts) else []


@arrow_udf(T.ArrayType(T.StringType()))
def _clean_words(runs: pa.Array) -> pa.Array:
    return pa.array([clean_words(r) for r in runs.to_pylist()], pa.list_(pa.string()))


def _form_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, records = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for n, chain in enumerate(CHAINS):
            # Read as UTF-8 without loss, a word is the garbled form of what comes out, not the other way round.
            lossy = chain[-1][1] == "utf-8"
            made = [
                (f, w, k) for f, w, k in zip(garble(words, chain), words, records, strict=True)
                if f != w and len(f) > 1 and "?" not in f and not f.isascii() and (not lossy or LOST in f)
            ]
            if made:
                form, word, known = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(word, pa.string()), pa.array([n] * len(made), pa.int32()), pa.array(known, pa.int64())], ["form", "word", "chain", "records"])


def garbled_forms(words: DataFrame) -> DataFrame:
    """form, word, chain, records of every word (word, records) under every chain that changes it."""
    return words.mapInArrow(_form_rows, "form string, word string, chain int, records long")


class Tiling:
    """Cuts a run into garbled forms of clean letters of one chain."""

    def __init__(self, letters: list[str]) -> None:
        self.forms: list[tuple[int, dict[str, str], list[int]]] = []
        for n, chain in enumerate(CHAINS):
            if chain[-1][1] in ONE_BYTE:  # only a one-byte decoder garbles letter by letter
                table: dict[str, str] = {}
                for form, letter in zip(garble(letters, chain), letters, strict=True):
                    if len(form) > 1 and "?" not in form and form != letter:
                        table.setdefault(form, letter)
                self.forms.append((n, table, sorted({len(f) for f in table}, reverse=True)))

    def read(self, run: str) -> tuple[int, str | None, int] | None:
        """(chain, original or null, tiles) of the best chain whose forms make up the run, or at least four fifths of it."""
        best = None
        for n, table, sizes in self.forms:
            at, tiles, covered, out = 0, 0, 0, []
            while at < len(run):
                for size in sizes:
                    letter = table.get(run[at : at + size]) if at + size <= len(run) else None
                    if letter is not None:
                        tiles, covered, at = tiles + 1, covered + size, at + size
                        out.append(letter)
                        break
                else:
                    # Blanks pass; everything else is not covered.
                    covered += run[at] in "\xa0　"
                    out.append(run[at])
                    at += 1
                if at - covered > len(run) // 5:
                    break
            else:
                whole = covered == len(run)
                utf8 = CHAINS[n][0][0] == "utf-8"
                # A single two-character form of a national code page is no proof: many clean pairs of signs look so.
                if tiles >= (1 if utf8 and whole else 2 if whole else 3):
                    rank = (covered, utf8, -tiles)
                    if best is None or rank > best[0]:
                        best = (rank, n, "".join(out) if whole else None, tiles)
        return best[1:] if best else None


_VERDICT = T.StructType([T.StructField("chain", T.IntegerType()), T.StructField("original", T.StringType())])


def _tiles(letters: list[str]):  # noqa: ANN202
    shared: dict[str, Tiling] = {}

    @arrow_udf(_VERDICT)
    def tiles(runs: pa.Array) -> pa.Array:
        if "t" not in shared:
            shared["t"] = Tiling(letters)
        out = []
        for run in runs.to_pylist():
            if LOST in run:
                out.append({"chain": -1, "original": None})
            else:
                hit = shared["t"].read(run)
                out.append(hit and {"chain": hit[0], "original": hit[1]})
        return pa.array(out, pa.struct([("chain", pa.int32()), ("original", pa.string())]))

    return tiles


def _runs(texts: DataFrame) -> DataFrame:
    return texts.select("src", "rec_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({RUN})"), 1))).alias("run"))


def garbled_runs(texts: DataFrame) -> DataFrame:
    """run, chain, original: the distinct garbled tokens of texts (src, rec_id, text); original is null where it is lost.

    Every distinct clean word of all texts, and every letter of these words, is garbled under all chains. Tokens that are not
    plainly clean meet the forms of words in a hash join (on the whole token or a part between blanks), and the forms of
    letters, a table of a few thousand letters whose size is checked, by cutting the token into them. Which of a token and the
    word whose form it is is the garbled one is told by the records they stand in (LONG, LEAD; SURE for single syllables);
    letters must make up the token. A token with a replacement character is garbled and its original lost, unless just one
    word has that form. If a token has several originals the longest is taken.

    Clean words meet the forms too, as Hangul read in a Chinese code page is wholly Han; a token that holds a garbled word is
    garbled.
    """
    runs = materialized(_runs(texts).groupBy("run").agg(F.count("*").alias("records")))
    in_runs = runs.select("run", "records", F.explode(_clean_words("run")).alias("word"))
    words = materialized(in_runs.groupBy("word").agg(F.sum("records").alias("records")))
    # Signs of text are garbled like letters.
    signs = runs.filter(F.col("run").rlike(f"^{_MARKS}+$")).select(F.explode(F.array_distinct(F.split("run", ""))).alias("c"))
    letters = words.select(F.explode(F.split("word", "")).alias("c")).unionByName(signs).filter("c > '\x7f'").distinct().limit(MAX_LETTERS + 1).collect()
    if len(letters) > MAX_LETTERS:
        raise ValueError(f"more than {MAX_LETTERS} clean letters")
    odd = materialized(runs.filter(~F.col("run").rlike(_PLAIN)))
    tiled = odd.withColumn("v", _tiles(sorted(r["c"] for r in letters))("run")).filter("v is not null").select("run", "v.chain", "v.original")
    tiled = materialized(tiled)
    parts = odd.select("run", F.col("records").alias("own"), F.explode(F.array_distinct(F.concat(F.array("run"), F.split("run", r"[\s\p{Z}]+")))).alias("form")).filter("length(form) > 1")
    keys = materialized(parts.select("run", "own", "form", F.xxhash64("form").alias("h")))
    latin = odd.filter(F.col("run").rlike(_LATIN)).join(tiled.select("run"), "run", "left_anti").select(F.col("run").alias("word"), "records")
    word_keys = words.filter("length(word) > 1").select(F.col("word").alias("run"), F.col("records").alias("own"), F.xxhash64("word").alias("h"))
    made = garbled_forms(words.unionByName(latin)).select(F.xxhash64("form").alias("h"), F.length("form").alias("n"), "word", "chain", "records")
    of_odd = ((F.col("n") >= 3) | (F.length("word") == 1) & F.col("chain").isin(_PAIRS)) & _might_be("h", _filter_bits(keys))
    of_clean = (F.length("word") > 1) & F.col("chain").isin(_WIDE) & _might_be("h", _filter_bits(word_keys))
    made = materialized(made.withColumn("of_odd", of_odd).withColumn("of_clean", of_clean).filter("of_odd or of_clean"))
    # A form of several words is lost: only what all have in common would be known.
    several = [F.min("chain").alias("chain"), F.min("word").alias("w1"), F.max("word").alias("w2"), F.max("n").alias("n")]
    long = F.when(F.col("n") >= LONG, F.col("own") <= LEAD * F.col("records"))
    evident = long.when(F.col("n") == 2, SURE * F.col("own") <= F.col("records")).otherwise(F.col("own") <= F.col("records"))
    joined = made.filter("of_odd").join(keys, "h").filter(evident).groupBy("run", "form").agg(*several)
    matched = joined.filter("n >= 4 or form = run").select("run", "chain", F.when((F.col("w1") == F.col("w2")) & (F.col("form") == F.col("run")), F.col("w1")).alias("original"))
    # Clean tokens that happen to be made of forms of letters are no matches.
    both = tiled.unionByName(matched).join(words.select(F.col("word").alias("run")), "run", "left_anti")
    alike = made.filter("of_clean").join(word_keys, "h").filter(long.otherwise(F.col("own") < F.col("records"))).groupBy("run").agg(*several)
    alike = alike.select(F.col("run").alias("word"), "chain", F.when(F.col("w1") == F.col("w2"), F.col("w1")).alias("original"))
    alike = materialized(alike)
    # The filter keeps runs without such a word out of the shuffle.
    held = in_runs.filter(_might_be(F.xxhash64("word"), _filter_bits(alike.select(F.xxhash64("word").alias("h"))))).select("run", "word").join(alike, "word")
    both = both.unionByName(held.select("run", "chain", F.when(F.col("run") == F.col("word"), F.col("original")).alias("original")))
    best = F.max(F.struct(F.col("original").isNotNull().alias("known"), F.length("original").alias("n"), "original", "chain"))
    return both.groupBy("run").agg(best.alias("b")).select("run", "b.chain", "b.original")


#: Bits of the filters that spare rows without a partner the way through the shuffle: so many a key, within these bounds (0.5 and
#: 32 MB). Beyond the upper one a filter lets more pass; it never changes a result.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 8, 1 << 22, 1 << 28


def _filter_bits(keys: DataFrame) -> bytes:
    """A Bloom filter (one hash) of the column h of the materialized keys: at most MOST_BITS / 64 rows reach the driver."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * keys.count()).bit_length()))
    slot = F.pmod("h", F.lit(size))
    words = keys.select(F.shiftrightunsigned(slot, 6).alias("i"), F.expr(f"shiftleft(1L, cast(pmod(h, {size}) & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    rows = words.toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[rows["i"].to_numpy()] = rows["b"].to_numpy()
    return bits.tobytes()


def _might_be(column: str | Column, bits: bytes) -> Column:
    """Whether a hash may be in the filter: never false for one that is."""
    shared = SparkSession.active().sparkContext.broadcast(bits)

    @arrow_udf(T.BooleanType())
    def might(hashes: pa.Array) -> pa.Array:
        table = np.frombuffer(shared.value, np.int64)
        slot = hashes.to_numpy(zero_copy_only=False) % (64 * len(table))
        return pa.array((table[slot >> 6] >> (slot & 63)) & 1 == 1)

    return might(column)


def _held(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The runs of texts that may be among the found ones: the filter keeps all others out of the shuffle."""
    return _runs(texts).filter(_might_be(F.xxhash64("run"), _filter_bits(found.select(F.xxhash64("run").alias("h")))))


def garbled_records(texts: DataFrame) -> DataFrame:
    """src, rec_id of each record of texts (src, rec_id, text) that holds a garbled token; repeated rows count once."""
    found = materialized(garbled_runs(texts).select("run"))
    return _held(texts, found).join(found, "run", "left_semi").select("src", "rec_id").distinct()


def repaired_runs(texts: DataFrame) -> DataFrame:
    """src, rec_id, run, original: the garbled tokens of each record with their verified originals (null where lost)."""
    found = materialized(garbled_runs(texts))
    return _held(texts, found).join(found, "run").select("src", "rec_id", "run", "original").distinct()


def project_texts(pages: DataFrame, attachments: DataFrame, docs: DataFrame) -> DataFrame:
    """src, rec_id, text of all places where texts of the project may be garbled; rows with a null id or text give none."""
    parts = [
        pages.select(F.lit("crawled_pages").alias("src"), F.col("page_id").alias("rec_id"), F.col("raw_html").alias("text")),
        attachments.select(F.lit("attachments").alias("src"), F.col("attachment_id").alias("rec_id"), F.col("filename").alias("text")),
        docs.select(F.lit("notice_docs").alias("src"), F.col("doc_id").alias("rec_id"), F.col("content").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("rec_id is not null and text is not null")

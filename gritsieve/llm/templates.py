"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question with other figures or other
people in it keeps its template. Windows of template tokens are hash-joined with those of the
benchmark; matches that line up in one place of a document must agree on what each slot of the
question became.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import bitmap_of, in_bitmap, query, slices, stored, table, worker_cache

# Scripts written without blanks between words: Thai and Lao, Burmese, Khmer, kana, Han. There a letter with its marks is a token.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3031, 0x3035), (0x303B, 0x303C), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFD))
_UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
_MARKS = "".join(chr(c) for a, b in UNSPACED if b < 0x10000 for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == "M")
_WORD = rf"[^\W\d_{_UNSPACED}]+"
TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|{_WORD}(?:['’]{_WORD})*|(?=[^\W\d_])[{_UNSPACED}][{_MARKS}]*|[%€$£°]")
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = (
    "% € $ £ ° mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hz khz mhz kb mb gb tb v w kw kwh j kj cal kcal mph kmh "
    "inch inches foot feet yard yards mile miles meter meters metre metres gram grams pound pounds ounce ounces liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degrees"
).split()
NUMBER_SET, UNIT_SET = frozenset(NUMBER_WORDS), frozenset(UNITS)
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
LITERAL_FLAG, NAME_FLAG = 1, 2
ODD = [int(x) | 1 for x in np.random.default_rng(20).integers(1, 2**63, 64)]


def canonical(token: str) -> tuple[str, str, str]:
    """A token's template with names kept as words, with names as slots, and with slots that keep their value."""
    low = token.lower()
    if token[0].isdecimal() or low in NUMBER_SET:
        return NUMBER, NUMBER, f"{NUMBER}={low}"
    if low in UNIT_SET:
        return UNIT, UNIT, f"{UNIT}={low}"
    return low, NAME if token[0].isupper() else low, low


class Codes(dict):
    """Chunks between white space -> code; tokens of a code with the hashes of their templates."""

    def __init__(self):
        self.start, self.count = array("q"), array("q")
        self.plain, self.named, self.exact, self.flags = array("Q"), array("Q"), array("Q"), array("b")
        self.raw: list[str] = []

    def __missing__(self, chunk: bytes) -> int:
        code = self[chunk] = len(self.start)
        self.start.append(len(self.raw))
        for token in TOKEN.findall(chunk.decode()):
            plain, named, exact = canonical(token)
            self.raw.append(token)
            self.plain.append(xxhash.xxh3_64_intdigest(plain))
            self.named.append(xxhash.xxh3_64_intdigest(named))
            self.exact.append(xxhash.xxh3_64_intdigest(exact))
            self.flags.append(LITERAL_FLAG * (plain[0] != "<") | NAME_FLAG * (named == NAME))
        self.count.append(len(self.raw) - self.start[-1])
        return code


def worker_codes(limit: int = 300_000) -> Codes:
    """The codes this worker has met in its tasks; begun anew when there are ``limit``, or four times as many tokens."""
    held = worker_cache("templates", lambda: [Codes()])
    if len(held[0]) > limit or len(held[0].raw) > 4 * limit:
        held[0] = Codes()
    return held[0]


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` values."""
    n = len(hashes) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(size if n > 0 else 0):
        out += hashes[j : j + n] * np.uint64(ODD[j])
    out ^= out >> np.uint64(31)
    return out * np.uint64(ODD[-1])


def rolling_at(hashes: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """``rolling(hashes, size)[at]``, without the others if they are many."""
    if 4 * len(at) > len(hashes):
        return rolling(hashes, size)[at]
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out += hashes[at + j] * np.uint64(ODD[j])
    out ^= out >> np.uint64(31)
    return out * np.uint64(ODD[-1])


def windows(texts: list[str | None], codes: Codes, sizes: list[int], literals: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per size and template view: the size, hashes of the windows, their texts' numbers and places, tokens (a column each).

    A window needs ``literals`` tokens that are no placeholder (half of a shorter window); the
    second view has only the windows that hold a name. The third view has the windows with fewer
    literal tokens, whose placeholders keep their values: there only the exact wording meets.
    """
    chunks = [(t or "").encode().split() for t in texts]
    flat = np.fromiter(map(codes.__getitem__, (c for ws in chunks for c in ws)), np.int64)
    start, count = np.array(codes.start, np.int64), np.array(codes.count, np.int64)
    n = count[flat]
    ends = np.cumsum(n)
    token = np.repeat(start[flat] - (ends - n), n) + np.arange(n.sum())
    text_ends = np.concatenate([[0], ends])[np.cumsum([len(ws) for ws in chunks], dtype=np.int64)]
    sizes_of = np.diff(text_ends, prepend=0)
    of = np.repeat(np.arange(len(texts)), sizes_of)
    place = np.arange(len(token)) - (text_ends - sizes_of)[of]
    flags = np.array(codes.flags, np.int8)[token]
    literal_sums = np.concatenate([[0], np.cumsum(flags & LITERAL_FLAG)])
    name_sums = np.concatenate([[0], np.cumsum((flags & NAME_FLAG) > 0)])
    plain, named, exact = (np.array(h, np.uint64)[token] for h in (codes.plain, codes.named, codes.exact))
    for size in sizes:
        if len(token) < size:
            continue
        least = min(literals, -(-size // 2))
        inside = of[: len(token) - size + 1] == of[size - 1 :]
        literal, names = literal_sums[size:] - literal_sums[:-size], name_sums[size:] - name_sums[:-size]
        views = ((plain, inside & (literal >= least)), (named, inside & (names > 0) & (literal - names >= least)), (exact, inside & (literal < least)))
        for hashes, kept in views:
            at = np.flatnonzero(kept)
            yield size, rolling_at(hashes, size, at), of[at], place[at], token, at


_SCHEMA = "h long, key long, row long, at long, size int, raw array<string>, template array<string>, n_tokens int"


def _windows(rows: DataFrame, sizes: list[int], literals: int, own_size: int = 0, bitmap=None, bits: int = 0) -> DataFrame:
    """Windows of (key, row, text) rows; with a bitmap only those whose hash has its bit set.

    With ``own_size``, texts of fewer tokens than that give one window of their own length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = worker_codes()
            keys, numbers, texts = (batch.column(i).to_pylist() for i in range(3))
            lengths = [sum(codes.count[codes[c]] for c in (t or "").encode().split()) for t in texts] if own_size else None
            wanted = sorted({*sizes, *(n for n in lengths if 0 < n < own_size)}) if own_size else sizes
            for n_view, (size, hashes, of, place, token, at) in enumerate(windows(texts, codes, wanted, literals)):
                if bitmap is not None:
                    hit = np.flatnonzero(in_bitmap(bitmap.value, hashes, bits))
                    hashes, of, place, at = hashes[hit], of[hit], place[hit], at[hit]
                elif size < own_size:
                    hit = np.flatnonzero(np.array(lengths)[of] == size)
                    hashes, of, place, at = hashes[hit], of[hit], place[hit], at[hit]
                view = n_view % 3
                for i in range(0, len(of), 20_000):
                    part = slice(i, i + 20_000)
                    raw = [[codes.raw[t] for t in token[a : a + size].tolist()] for a in at[part].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes[part].view(np.int64)),
                            pa.array([keys[o] for o in of[part].tolist()], pa.int64()),
                            pa.array([numbers[o] for o in of[part].tolist()], pa.int64()),
                            pa.array(place[part]),
                            pa.array(np.full(len(raw), size, np.int32)),
                            pa.array(raw, pa.list_(pa.string())),
                            pa.array([[canonical(t)[view] for t in r] for r in raw], pa.list_(pa.string())),
                            pa.array([lengths[o] if lengths else 0 for o in of[part].tolist()], pa.int32()),
                        ],
                        ["h", "key", "row", "at", "size", "raw", "template", "n_tokens"],
                    )

    return rows.mapInArrow(run, _SCHEMA)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = 8, literals: int = 4, shortest: int = 5, run: int = 13, share: float = 0.5, bits: int = 26, salts: int = 16, at: str | None = None,
) -> DataFrame:
    """(doc_id, item_id, covered, n_tokens, changed): the documents that hold a benchmark item's wording.

    A document is listed with an item if windows that line up cover ``run`` of the item's
    tokens or, if that is less, the ``share`` of them. Windows whose slots hold the item's own
    values always count. Those with other values count if all windows on their diagonal (document
    place minus item place) agree on the slots: a value of the item has one counterpart, and two
    names do not become the same. ``changed`` tells whether a counted slot holds another value.

    The benchmark's window hashes fill a bitmap of 2**bits bits, the only thing broadcast, of a
    size that no table changes; document windows outside it are left where they are, the others
    join the benchmark's windows by hash and salt, so that a passage many documents share is no
    single task, and are compared template by template, so neither bits nor hashes decide.

    Slots are compared without regard to case. Windows of fewer than ``literals`` literal tokens meet
    only their exact wording. Items of fewer than ``size`` tokens are one window of their own length; those of fewer than
    ``shortest`` tokens are too short to be evidence. In scripts without blanks a letter is a token. Null and empty texts match nothing;
    rows are judged one by one, and equal keys share the row of best coverage, unless ``at`` names a column of unique
    numbers: then each row has its own result, with its number as ``at``, whatever its key; several items with an equal text are
    listed each; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    place = F.monotonically_increasing_id().alias("row")
    items = benchmark.select(F.col(item).cast("long").alias("key"), place, F.col(item_text).cast("string").alias("text"))
    known = stored(_windows(items, [size], literals, own_size=size).where(F.col("n_tokens") >= shortest))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most ``size`` numbers
    bitmap = bitmap_of(known, bits)
    own_place = place if at is None else F.col(at).cast("long").alias("row")
    rows = docs.select(F.col(key).cast("long").alias("key"), own_place, F.col(text).cast("string").alias("text"))
    met = _windows(rows, sizes, literals, bitmap=spark.sparkContext.broadcast(bitmap), bits=bits)
    left = met.select("h", "size", F.col("key").alias("doc_id"), "row", F.col("at").alias("doc_at"), F.col("raw").alias("doc_raw"), F.col("template"), F.pmod(F.xxhash64("key", "at"), F.lit(salts)).alias("salt"))
    right = known.select("h", "size", F.col("key").alias("item_id"), F.col("at").alias("item_at"), F.col("raw").alias("item_raw"), F.col("template").alias("item_template"), "n_tokens").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    )
    pairs = left.join(right, ["h", "size", "salt"]).where("template = item_template")
    slots = F.filter(
        F.transform(F.arrays_zip("template", "item_raw", "doc_raw"), lambda t: F.struct(F.substring_index(t["template"], "=", 1).alias("kind"), F.lower(t["item_raw"]).alias("was"), F.lower(t["doc_raw"]).alias("now"))),
        lambda t: t["kind"].isin(NUMBER, UNIT, NAME),
    )
    covers = F.sequence("item_at", F.col("item_at") + F.col("size") - 1)
    pairs = pairs.withColumn("slots", slots)
    lined = pairs.groupBy("doc_id", "row", "item_id", "n_tokens", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).agg(
        F.flatten(F.collect_set(covers)).alias("places"),
        F.flatten(F.collect_set(F.when(F.forall("slots", lambda t: t["was"] == t["now"]), covers))).alias("same_places"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )

    def of(chosen, *fields: str):
        return F.size(F.array_distinct(F.transform(chosen, lambda t: F.struct(*[t[f] for f in fields]))))

    names = F.filter("slots", lambda t: t["kind"] == NAME)
    consistent = (of(F.col("slots"), "kind", "was") == F.size("slots")) & (of(names, "now") == F.size(names))
    lined = lined.withColumn("consistent", consistent).withColumn("places", F.when(F.col("consistent"), F.col("places")).otherwise(F.col("same_places")))
    found = (
        lined.where(F.size("places") > 0)
        .groupBy("doc_id", "row", "item_id", "n_tokens")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("places"))))).alias("covered"),
            F.max(F.col("consistent") & F.exists("slots", lambda t: t["was"] != t["now"])).alias("changed"),
        )
    )
    found = found.where(F.col("covered") >= F.least(F.lit(run), F.ceil(F.col("n_tokens") * share)))
    if at is not None:
        return found.select(F.col("row").alias("at"), "doc_id", "item_id", "covered", "n_tokens", "changed")
    best = F.max(F.struct("covered", ~F.col("changed"), "n_tokens"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.covered", "b.n_tokens", (~F.col("b.col2")).alias("changed"))


@query("op4_templates")
def op4_templates(spark, folder):
    """The documents that hold benchmark items, with other figures and names or the same."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

"""Phrase collocations from suffix pointers sorted by multikey three-way quicksort.

Every word of a piece of text points to the suffix that starts there. Suffixes are routed by
their leading words, each task sorts the pointers of a run by three-way partitions, word after
word, and the size of an equal partition is the count of the phrase that its members share.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritsieve.llm.common import query, slices, stored, table
from gritsieve.operators.groups import lookup

DEPTH = 4  # words of the longest phrase
BREAK = b"\xff"  # no byte of UTF-8 text
_ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in _ENDS else 32 if b == 9 else b for b in range(256))
NO_LANG = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """The words of all pieces in order, BREAK between pieces."""
    return text.translate(FOLD).replace(b"\n", b" " + BREAK + b" ").split()


class Numbers:
    """Words as numbers from 1 in order of first sight; 0 stands for the end of a piece."""

    def __init__(self):
        self.words: list[bytes] = []
        self.number: dict[bytes, int] = {BREAK: 0}

    def of(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        for w in set(words).difference(number):
            self.words.append(w)
            number[w] = len(self.words)
        return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def suffixes(ids: np.ndarray) -> np.ndarray:
    """(n, DEPTH): the words from each word on, 0 from the end of its piece."""
    out = np.zeros((len(ids), DEPTH), np.int32)
    padded = np.r_[ids, np.zeros(DEPTH, ids.dtype)]
    inside = np.ones(len(ids), bool)
    for d in range(DEPTH):
        column = padded[d : d + len(ids)]
        inside = inside & (column > 0)
        out[:, d] = np.where(inside, column, 0)
    return out[ids > 0]


def merged(rows: np.ndarray, counts: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal suffixes as one, their counts added."""
    base = n_words + 1
    key = lambda d: rows[:, d].astype(np.int64)  # the numbers of words are 32 bits wide, their products 64
    if base < 1 << 15:
        keys = ((key(0) * base + key(1)) * base + key(2)) * base + key(3)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    else:
        order = np.lexsort((key(2) * base + key(3), key(0) * base + key(1)))
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for d in range(DEPTH):
            column = rows[order, d]
            new[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(new)
    return rows[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def frequent_prefixes(rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Phrases of 1 to DEPTH words that at least ``least`` suffixes begin with, and their counts.

    Multikey three-way quicksort of the pointers: a partition is split by one word of its
    members into less, equal and greater; the equal part is a phrase and goes on with the next
    word. Partitions below ``least`` are abandoned, as nothing inside can be more frequent.
    """
    stack = [(np.arange(len(rows)), 0, int(counts.sum()))]
    columns = [np.ascontiguousarray(rows[:, d]) for d in range(DEPTH)]
    while stack:
        members, depth, total = stack.pop()
        if total < least:
            continue
        values = columns[depth][members]
        n = len(values)
        if n == 1:
            equal, pivot, weight = members, int(values[0]), total
        else:
            a, b, c = int(values[0]), int(values[n // 2]), int(values[-1])
            pivot = max(min(a, b), min(max(a, b), c))
            same = values == pivot
            equal = members[same]
            weight = total if len(equal) == n else int(counts[equal].sum())
            if weight < total:
                less = members[values < pivot]
                low = int(counts[less].sum())
                if low >= least:
                    stack.append((less, depth, low))
                if total - weight - low >= least:
                    stack.append((members[values > pivot], depth, total - weight - low))
        if pivot and weight >= least:
            first = equal[0]
            yield tuple(int(columns[d][first]) for d in range(depth + 1)), weight
            if depth + 1 < DEPTH:
                stack.append((equal, depth + 1, weight))


def hashes_of(words: list[bytes]) -> np.ndarray:
    """A number for each word that says where its suffixes go; clashes only share a task."""
    return np.array([0, *(zlib.crc32(w) for w in words)], np.uint64)


def routes(rows: np.ndarray, depths: np.ndarray, hashes: np.ndarray, lang: str) -> np.ndarray:
    """A 31-bit number from the language and each suffix's first ``depths`` words."""
    out = np.full(len(rows), zlib.crc32(lang.encode()), np.uint64)
    for d in range(DEPTH):
        more = (out ^ hashes[rows[:, d]]) * MIX
        out = np.where(d < depths, more ^ (more >> np.uint64(29)), out)
    return (out & np.uint64(0x7FFFFFFF)).astype(np.int64)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The words of a batch's texts by language, a break after each text."""
    langs = np.array(batch.column("lang").to_pylist(), object)
    texts = batch.column("text").to_pylist()
    for lang in sorted(set(langs.tolist())):
        data = b"\n".join(texts[i] for i in np.flatnonzero(langs == lang).tolist())
        yield lang, words_of(data)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")
    )


def heavy_prefixes(texts: DataFrame, size: int, sample_bytes: int, share: float) -> dict[str, set[bytes]]:
    """Phrases of 1 to 3 words that begin more than ``share`` of all suffixes, judged by a sample of texts.

    They only decide by how many words a suffix is routed, so that no route is heavy; counts
    do not depend on them. At most 3 / share of them exist.
    """
    part = min(1 << 30, (1 << 30) * sample_bytes // max(1, size))
    chosen = texts.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) < part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches):
            for lang, words in _by_lang(batch):
                numbers = Numbers()
                rows = suffixes(numbers.of(words))
                found[(lang, b"")] += len(rows)
                least = max(2, int(len(rows) * share / 2))
                for phrase, n in frequent_prefixes(*merged(rows, np.ones(len(rows), np.int64), len(numbers.words)), least):
                    if len(phrase) < DEPTH:
                        found[(lang, b" ".join(numbers.words[i - 1] for i in phrase))] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([found[k] for k in keys], pa.int64())],
            ["lang", "phrase", "n"],
        )

    counts = stored(chosen.mapInArrow(run, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    total = counts.where(F.octet_length("phrase") == 0).agg(F.sum("n")).first()[0]
    out: dict[str, set[bytes]] = {}
    if total:
        for r in counts.where((F.octet_length("phrase") > 0) & (F.col("n") > total * share)).collect():
            out.setdefault(r["lang"], set()).add(bytes(r["phrase"]))
    return out


PACKED = "route long, lang string, words binary, ids binary, counts binary"


def packed_suffixes(texts: DataFrame, heavy: dict[str, set[bytes]], pieces: int) -> DataFrame:
    """Suffixes of a batch by route, equal ones as one, with the words they use; and the counts of heavy prefixes.

    Heavy prefixes are counted where the text is read, as their suffixes part; a row without
    ``ids`` holds such counts, and the number of all words under the empty phrase.
    """
    sent = texts.sparkSession.sparkContext.broadcast(heavy)

    def counted(lang: str, phrases: list[bytes], counts: np.ndarray) -> dict:
        return {"route": zlib.crc32(lang.encode()) % pieces, "lang": lang, "words": b"\n".join(phrases), "ids": None, "counts": counts.astype("<i8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("route", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
        known: dict[tuple[str, bytes], int] = {}
        for batch in slices(batches, limit=4 << 20):
            out = []
            for lang, words in _by_lang(batch):
                numbers = Numbers()
                rows = suffixes(numbers.of(words))
                del words
                if not len(rows):
                    continue
                known[(lang, b"")] = known.get((lang, b""), 0) + len(rows)
                n_words = len(numbers.words)
                rows, counts = merged(rows, np.ones(len(rows), np.int64), n_words)
                depths = np.ones(len(rows), np.int64)
                hot = sent.value.get(lang, set())
                base = n_words + 1
                for phrase in sorted(hot, key=lambda p: p.count(b" ")):  # shorter ones first
                    ids = [numbers.number.get(w) for w in phrase.split(b" ")]
                    if None in ids:
                        continue
                    low, high = 0, len(rows)  # rows are in order, so a prefix is a stretch of them
                    for d, i in enumerate(ids):
                        column = rows[low:high, d]
                        low, high = low + int(np.searchsorted(column, i)), low + int(np.searchsorted(column, i, "right"))
                    if high > low:
                        depths[low:high] = len(ids) + 1
                        known[(lang, phrase)] = known.get((lang, phrase), 0) + int(counts[low:high].sum())
                where = routes(rows, depths, hashes_of(numbers.words), lang) % pieces
                order = np.argsort(where, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(where[order]) != 0, True])
                renumber = np.zeros(base, np.int64)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    chosen = order[a:b]
                    part = rows[chosen]
                    used = np.unique(part)
                    used = used[used > 0]
                    renumber[used] = np.arange(1, len(used) + 1)
                    kind = "<u2" if len(used) < 1 << 16 else "<u4"
                    text = b"\n".join([numbers.words[i - 1] for i in used.tolist()])
                    ids, n = renumber[part].T.astype(kind).tobytes(), counts[chosen].astype("<u4").tobytes()
                    out.append({"route": int(where[chosen[0]]), "lang": lang, "words": text, "ids": ids, "counts": n})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        last = []
        for lang in sorted({k[0] for k in known}):
            mine = [k for k in known if k[0] == lang]
            last.append(counted(lang, [k[1] for k in mine], np.array([known[k] for k in mine])))
        if last:
            yield pa.RecordBatch.from_pylist(last, schema=schema)

    return texts.mapInArrow(run, PACKED)


COUNTED = "lang string, phrase string, len int, n long"


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, share: float = 1 / 4096, sample_bytes: int = 16 << 20, piece_bytes: int = 8 << 20, run_rows: int = 1 << 21) -> DataFrame:
    """(lang, phrase, len, n): all phrases of 1 to 4 words with at least ``least`` occurrences, and, as the empty phrase, all words.

    A task holds about ``piece_bytes`` of text as suffixes at a time. Suffixes under a prefix
    with more than ``share`` of all are routed by one word more, so at any size no route holds
    more than that share. Should a route still exceed ``run_rows`` different suffixes, it is
    sorted in runs whose partial counts are kept whole and added.
    """
    texts = _texts(docs, text, lang)
    size = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    pieces = max(8, size // piece_bytes)
    heavy = heavy_prefixes(texts, size, sample_bytes, max(share, 1 / (8 * pieces)))
    rows = packed_suffixes(texts, heavy, pieces)
    sent = texts.sparkSession.sparkContext.broadcast(heavy)

    def sort_run(lang: str, held: list[tuple], whole: bool) -> list[tuple[str, str, int, int]]:
        numbers = Numbers()
        total, at = sum(len(counts) for _, _, counts in held) // 4, 0
        rows, weights = np.empty((total, DEPTH), np.int32), np.empty(total, np.int64)
        while held:  # what is unpacked is let go
            words, ids, counts = held.pop()
            own = words.split(b"\n")
            n = len(counts) // 4
            kind = "<u2" if len(own) < 1 << 16 else "<u4"
            local = np.frombuffer(ids, kind).reshape(DEPTH, -1).T
            rows[at : at + n] = np.r_[np.int32(0), numbers.of(own)][local]
            weights[at : at + n] = np.frombuffer(counts, "<u4")
            at += n
        rows, counts = merged(rows, weights, len(numbers.words))
        hot, out = sent.value.get(lang, set()), []
        for phrase, n in frequent_prefixes(rows, counts, least if whole else 1):
            text = b" ".join([numbers.words[i - 1] for i in phrase])
            if text not in hot:  # counted where the text was read
                out.append((lang, text.decode(), len(phrase), n))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("len", pa.int32()), ("n", pa.int64())])
        at, held, size, whole = None, [], 0, True
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for batch in batches:
            for r in range(len(batch)):
                route, lang, words, ids, counts = (batch.column(c)[r].as_py() for c in range(5))
                if ids is None:
                    phrases = words.split(b"\n")
                    ns = np.frombuffer(counts, "<i8").tolist()
                    yield batch_of([(lang, p.decode(), len(p.split(b" ")) if p else 0, n) for p, n in zip(phrases, ns)])
                    continue
                if (route, lang) != at or size >= run_rows:
                    whole = whole and (route, lang) != at
                    if held and (out := sort_run(at[1], held, whole)):
                        yield batch_of(out)
                    held, size, whole = [], 0, (route, lang) != at
                    at = (route, lang)
                held.append((words, ids, counts))
                size += len(counts) // 4
        if held and (out := sort_run(at[1], held, whole)):
            yield batch_of(out)

    # a task for each route: hashed or joined by adaptive execution, many routes would make one large Arrow batch
    dealt = rows.repartitionById(pieces, F.col("route").cast("int")).sortWithinPartitions("route", "lang")
    found = dealt.mapInArrow(run, COUNTED).groupBy("lang", "phrase", "len").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least) | (F.col("len") == 0))


def _part(start: str, length: str) -> str:
    return f"array_join(slice(words, {start}, {length}), ' ')"


def scored_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of two words or more, by its lowest-scoring cut.

    The counts of a phrase's parts come by a lookup that no part, however common, can skew.
    """
    phrases = counts.where("len >= 2").select("lang", "phrase", F.col("n").alias("a"), "len", F.split("phrase", " ").alias("words"))
    cuts = phrases.select("*", F.explode(F.expr("sequence(1, len - 1)")).alias("k"))
    sides = cuts.select(
        "lang", "phrase", "a", "k", F.explode(F.array(F.expr(f"struct(true AS first, {_part('1', 'k')} AS part)"), F.expr(f"struct(false AS first, {_part('k + 1', 'len - k')} AS part)"))).alias("s")
    ).select("lang", "phrase", "a", "k", "s.first", "s.part")
    sides = stored(sides)
    sizes = sides.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("size"))
    facts = counts.where("len > 0").select("lang", F.col("phrase").alias("part"), "n").join(sizes, ["lang", "part"])
    told = lookup(sides, stored(facts), ["lang", "part"], ["n"], "size")
    both = told.groupBy("lang", "phrase", "k").agg(
        F.max("a").alias("a"), F.max(F.when(F.col("first"), F.col("n"))).alias("l"), F.max(F.when(~F.col("first"), F.col("n"))).alias("r")
    )
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000BD) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = both.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r")).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covering(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the most frequent longer phrase that holds a phrase's words in line."""
    longer = counts.where("len >= 3").select("lang", "n", "len", F.split("phrase", " ").alias("words"))
    inside = longer.select("lang", "n", "len", "words", F.explode(F.expr("sequence(2, len - 1)")).alias("m"))
    inside = inside.select("lang", "n", "words", "m", F.explode(F.expr("sequence(1, len - m + 1)")).alias("at"))
    return inside.select("lang", "n", F.expr(_part("at", "m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def ranked_by_parts(rows: DataFrame, group: str, name: str, best: list, top: int, part_rows: int = 100_000) -> DataFrame:
    """The first ``top`` rows of each group with their rank; parts are ranked first, as often as it takes, so no task ranks a large group."""
    n = rows.count()
    while n > 2 * part_rows and n > 4 * top:
        part = F.pmod(F.xxhash64(name), F.lit(n // part_rows))
        place = F.row_number().over(Window.partitionBy(group, part).orderBy(*best))
        rows = stored(rows.withColumn("rank", place).where(F.col("rank") <= top).drop("rank"))
        before, n = n, rows.count()
        if n > before // 2:  # as many groups as rows: what is left is small in each
            break
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*best))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, cover: int = 80, top: int = 2000, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 4 words.

    A phrase counts with all its occurrences inside pieces, overlapping ones included, if they
    are ``least`` or more; it is left out if a longer phrase around it has ``cover`` percent of
    its occurrences. Null texts are empty, null languages are ``und``; texts are counted whole,
    repeated rows each time, without regard to keys; ties are ranked by count and phrase, so
    ranks repeat. Empty tables and texts without words give no rows; other columns are ignored.
    """
    counts = stored(phrase_counts(docs, text, lang, least, **how))
    scored = scored_phrases(counts).join(covering(counts), ["lang", "phrase"], "left")
    covered = F.expr(f"CAST(longer AS DECIMAL(20, 0)) * 100BD >= CAST(a AS DECIMAL(20, 0)) * {int(cover)}BD")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = ranked_by_parts(stored(scored.where(~F.coalesce(covered, F.lit(False))).drop("longer")), "lang", "phrase", best, top)
    totals = counts.where("len = 0").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, ws FROM (
  SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)) WHERE len(ws) > 0),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
o AS (SELECT lang, ws, s, k FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS s FROM p), range(1, 5) r(k) WHERE s + k - 1 <= len(ws)),
f AS (SELECT lang, array_to_string(ws[s:s + k - 1], ' ') AS phrase, k, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k AS len, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
x AS (SELECT lang, phrase, a, ws, unnest(range(1, len)) AS k FROM c),
y AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * x.a) // (l.f + r.f) AS BIGINT) AS score FROM x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1:x.k], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.k + 1:], ' ')),
b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM (
    SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, a, len, unnest(range(1, len)) AS s FROM c), range(2, 4) r(m)
    WHERE m < len AND s + m - 1 <= len GROUP BY ALL) g WHERE g.lang = b.lang AND g.phrase = b.phrase AND 100 * CAST(longer AS HUGEINT) >= 80 * CAST(b.a AS HUGEINT))),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_suffix_quicksort", _SQL)
def op11_suffix_quicksort(spark, folder):
    """The 2000 best collocations of every language."""
    out = collocations(table(spark, folder, "documents"))
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

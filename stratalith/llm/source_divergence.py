"""How far the sources of a language diverge in their terms, and by which terms each stands out.

Each source of a language is a vector of smoothed term probabilities, cut at ranges of terms and compressed. Sources are
dealt to seats; seats play a round-robin tournament (circle method): in each round a seat meets one other, one of the two
stays where it is and the other's compressed vectors travel to it, and both directions are evaluated there. Seats and
ranges of terms are tasks of their own, so neither a large source nor many sources meet in one. The language's own vector
visits every seat once; there local heaps keep each source's leading terms.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import numbered, renamed, staged
from .tokens import released, text_chunks

#: Bytes of text that a task counts before it gives its counts on; terms of a range; sources of a seat; rounds of a task.
SHARD_BYTES, RANGE, TEAM, LAP = 12 << 20, 1 << 16, 8, 8
SCALE = 1_000_000_000
#: Letters stay (A-Z as a-z), as do bytes of other than ASCII characters; all else is blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("cnt", pa.int64()), ("df", pa.int64())])
_FOUND = pa.schema([("gid", pa.int64()), ("peer", pa.int64()), ("value", pa.int64()), ("shared", pa.int64()), ("tid", pa.int64())])


def _counted(shard_bytes: int):
    """Occurrences and documents of each term by language and source, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        data, lengths, docs, group_of, size = [], [], [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal size
            n, of, doc = sum(map(len, group_of)), np.concatenate(group_of), np.concatenate(docs)
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths), dtype=np.int64)))
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data))]).dictionary_encode()
            each, cnt = np.unique(words.indices.to_numpy().astype(np.int64) * n + doc, return_counts=True)
            key, at, df = np.unique(each // n * len(groups) + of[each % n], return_inverse=True, return_counts=True)
            total = np.bincount(at, cnt, len(key)).astype(np.int64)
            names = [pa.array([g[k] for g in groups], pa.string()) for k in (0, 1)]
            terms = words.dictionary.take(pa.array(key // len(groups))).cast(pa.large_string()).cast(pa.string())
            for i in range(0, len(key), 1 << 16):
                g = pa.array(key[i : i + (1 << 16)] % len(groups))
                yield pa.record_batch([names[0].take(g), names[1].take(g), terms[i : i + len(g)], pa.array(total[i : i + len(g)]), pa.array(df[i : i + len(g)])], schema=_COUNTS)
            for held in (data, lengths, docs, group_of, groups):
                held.clear()
            size = 0

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for part, texts in text_chunks(batch.column("text")):
                buf = np.frombuffer((b" ".join(texts) + b" ").translate(_BYTES), np.uint8)
                inside = np.concatenate(([False], buf != 32))
                edge = np.flatnonzero(inside[1:] != inside[:-1])
                ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
                docs.append((np.searchsorted(ends, edge[::2], "right") + sum(map(len, group_of))).astype(np.int32))
                data.append(buf[inside[1:]])
                lengths.append((edge[1::2] - edge[::2]).astype(np.int32))
                group_of.append(np.array([groups.setdefault(g, len(groups)) for g in zip(langs[part], sources[part], strict=True)], np.int64))
                size += len(buf)
                if size >= shard_bytes:
                    yield from rows()
        if size:
            yield from rows()

    return run


def _probabilities(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / whole); in Python's own numbers where the product passes 64 bits."""
    if counts.max(initial=0) < 9_000_000_000:
        return 1 + (counts + 1) * SCALE // whole
    return np.array([1 + (int(c) + 1) * SCALE // int(whole) for c in counts], np.int64)


def _zip(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _unzip(x: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind).astype(np.int64) if x else np.zeros(0, np.int64)


def _vectors(cells: DataFrame, span: int) -> DataFrame:
    """gid, block, terms, ps: the probabilities of a range of terms in one row. cells: gid, tid, cnt, whole."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tid, cnt = table.column("tid").to_numpy(), table.column("cnt").to_numpy()
        order = np.argsort(tid, kind="stable")
        ps = _probabilities(cnt[order], table.column("whole")[0].as_py())
        row = [[key[0].as_py()], [key[1].as_py()], [_zip(tid[order] % span, "<u2")], [_zip(ps, "<i4")]]
        return pa.table([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["gid", "block", "terms", "ps"])

    return cells.withColumn("block", F.expr(f"tid div {span}")).groupBy("gid", "block").applyInArrow(pack, "gid long, block long, terms binary, ps binary")


class Vector:
    """A source's probabilities in one range of terms; ``rest`` is that of the terms it lacks."""

    def __init__(self, row: dict):
        self.gid, self.rest, self.terms, self.ps = row["gid"], row["rest"] or 1, _unzip(row["terms"], "<u2"), _unzip(row["ps"], "<i4")

    def spread(self, span: int) -> Vector:
        self.all = np.full(span, self.rest, np.int64)
        self.all[self.terms] = self.ps
        return self

    def lacks(self, span: int) -> np.ndarray:
        out = np.ones(span, bool)
        out[self.terms] = False
        return out


def divergence(p, q):
    return (p - q) * (p - q) // q


def meeting(a: Vector, b: Vector, b_lacks: np.ndarray) -> list[tuple]:
    """Both directions over the terms that one of the two has, and how many these are."""
    p = a.all[b.terms]
    alone = a.ps[b_lacks[a.terms]]
    ab = int(divergence(p, b.ps).sum() + divergence(alone, b.rest).sum())
    ba = int(divergence(b.ps, p).sum() + divergence(b.rest, alone).sum())
    n = len(p) + len(alone)
    return [(a.gid, b.gid, ab, n, None), (b.gid, a.gid, ba, n, None)]


def leading_terms(a: Vector, whole: Vector, first: int, top: int) -> list[tuple]:
    """The terms that a source has oftener than its language, the most divergent ``top`` of this range, from a heap."""
    q = whole.all[a.terms]
    more = a.ps > q
    value, tid = divergence(a.ps[more], q[more]), a.terms[more] + first
    if len(value) > top:
        some = value >= np.partition(value, -top)[-top]
        value, tid = value[some], tid[some]
    return [(a.gid, None, -v, None, t) for v, t in heapq.nsmallest(top, zip((-value).tolist(), tid.tolist(), strict=True))]


def _tournament(top: int, span: int):
    """What happens at a seat in some rounds: left are the sources that sit there, right those that come by, by round."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        home, out = [Vector(r).spread(span) for r in left.to_pylist()], []
        if home and left.column("lap")[0].as_py() == 0:
            for i, b in enumerate(home):
                lacks = b.lacks(span)
                for a in home[:i]:
                    out += meeting(a, b, lacks)
        for row in sorted(right.to_pylist(), key=lambda r: (r["round"], r["gid"])) if home else ():
            guest = Vector(row)
            if guest.gid < 0:
                guest.spread(span)
                for a in home:
                    out += leading_terms(a, guest, row["block"] * span, top)
            else:
                lacks = guest.lacks(span)
                for a in home:
                    out += meeting(a, guest, lacks)
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(_FOUND.types)], schema=_FOUND)

    return run


def opponent(seat: Column, rnd: Column, seats: Column) -> Column:
    """The seat that ``seat`` meets in a round of the circle method; ``seats`` is even (an odd number of seats has one more that stays empty)."""
    ring = seats - 1
    other = F.pmod(rnd - seat, ring)
    return F.when(seat == ring, F.pmod(rnd * (seats / 2).cast("long"), ring)).when(other == seat, ring).otherwise(other)


def stays(seat: Column, other: Column) -> Column:
    """Whether ``seat`` is where the two meet: the lower of two whose sum is even, else the higher, so that each seat stays about every other time."""
    return F.when((seat + other) % 2 == 0, seat < other).otherwise(seat > other)


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200, team: int = TEAM, lap: int = LAP, span: int = RANGE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: a row per ordered pair of a language's sources, and per leading term of a source.

    A term counts where ``least_docs`` documents of its language have it. p = 1 + floor(10^9 (count + 1) / (N + V)) with N the
    source's counted occurrences and V the language's terms; (p - q)^2 / q, floored, is a term's divergence: of pairs its sum over
    all V terms, of terms that against the language. Null texts, languages and sources are ''; a source without terms takes part;
    rows that repeat are documents each; an empty table gives none. Ties go by the item's bytes.
    ``team`` sources sit together, a task plays ``lap`` rounds in one range of ``span`` terms (65,536 at most). Other columns are ignored.
    """
    rows = renamed(docs, text=text_col, lang=lang_col, source=source_col).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = rows.mapInArrow(released(_counted(shard_bytes)), "lang string, source string, term string, cnt long, df long")
    counts = staged(counts.groupBy("lang", "source", "term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df")), "divergence-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt")).where(F.col("df") >= least_docs)
    # Numbers of terms follow their order, so ties can be settled by number and a language's terms are one range.
    terms = staged(numbered(terms.select("lang", "term", "cnt").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term"), "tid", "divergence-terms"), "divergence-terms")
    langs = staged(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("cnt").alias("n"), F.min("tid").alias("t0"), F.max("tid").alias("t1")), "divergence-langs")
    cells = staged(counts.select("lang", "source", "term", "cnt").join(terms.select("lang", "term", "tid"), ["lang", "term"]).select("lang", "source", "tid", "cnt"), "divergence-cells")

    sizes = cells.groupBy("lang", "source").agg(F.sum("cnt").alias("n"))
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).drop("docs").join(sizes, ["lang", "source"], "left")
    groups = numbered(groups.repartitionByRange("lang", "source").sortWithinPartitions("lang", "source"), "gid", "divergence-groups")
    teams = groups.groupBy("lang").agg(F.min("gid").alias("g0"), F.ceil(F.count(F.lit(1)) / team).alias("seats"))
    groups = groups.join(teams, "lang").join(langs.select("lang", "v", "t0", "t1"), "lang", "left")
    whole = F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))
    groups = groups.select("lang", "source", "gid", F.coalesce("v", F.lit(0)).alias("v"), "t0", "t1", whole.alias("whole"), F.expr(f"(gid - g0) div {team}").alias("seat"), F.col("seats").cast("long").alias("seats"))
    groups = staged(groups.withColumn("rest", F.when(F.col("whole") > 0, 1 + F.expr(f"{SCALE}L div whole"))), "divergence-groups")

    own = cells.join(groups.select("lang", "source", "gid", "whole"), ["lang", "source"]).select("gid", "tid", "cnt", "whole")
    blocks = F.when(F.col("t0").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.expr(f"t0 div {span}"), F.expr(f"t1 div {span}")))
    # Every source has a row in every range of its language's terms: what it lacks counts as well.
    grid = groups.select("lang", "gid", "rest", "seat", "seats", F.explode(blocks).alias("block"))
    vectors = staged(grid.join(_vectors(own, span), ["gid", "block"], "left"), "divergence-vectors")
    of_lang = langs.join(groups.groupBy("lang").agg((-1 - F.min("gid")).alias("gid"), F.max("seats").alias("seats")), "lang").select("lang", "gid", "seats", (F.col("n") + F.col("v")).alias("whole"))
    lang_cells = terms.join(of_lang, "lang").select("gid", "tid", "cnt", "whole")
    lang_vectors = _vectors(lang_cells, span).join(of_lang.select("gid", "lang", "seats"), "gid")

    even = F.col("seats") + F.col("seats") % 2
    rounds = even - 1
    laps = F.greatest(F.lit(1), F.ceil(F.when(F.col("seats") > 1, rounds).otherwise(0) / lap)).cast("long")
    columns = ["gid", "rest", "terms", "ps"]
    sit = vectors.select("lang", "block", "seat", F.explode(F.sequence(F.lit(0).cast("long"), laps - 1)).alias("lap"), *columns)
    travel = vectors.where("seats > 1").select("lang", "block", F.col("seat").alias("from"), "seats", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)).alias("round"), *columns)
    travel = travel.withColumn("seat", opponent(F.col("from"), F.col("round"), even)).where((F.col("seat") < F.col("seats")) & stays(F.col("seat"), F.col("from")))
    visit = lang_vectors.select("lang", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seats") - 1)).alias("seat"), F.lit(-1).cast("long").alias("round"), "gid", F.lit(1).cast("long").alias("rest"), "terms", "ps")
    guests = travel.select("lang", "block", "seat", "round", *columns).unionByName(visit.select("lang", "block", "seat", "round", *columns))
    # Both sides come from the same rows: the aliases tell their columns apart.
    sit = sit.select(*[F.col(c).alias(c) for c in ("lang", "block", "seat", "lap", *columns)])
    guests = guests.withColumn("lap", F.greatest(F.lit(0).cast("long"), F.expr(f"round div {lap}")))
    found = sit.groupBy("lang", "block", "seat", "lap").cogroup(guests.groupBy("lang", "block", "seat", "lap")).applyInArrow(_tournament(top, span), "gid long, peer long, value long, shared long, tid long")
    found = staged(found, "divergence-found")
    return _ranked(found, groups, terms, top)


def _ranked(found: DataFrame, groups: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    pairs = found.where("tid IS NULL").groupBy("gid", "peer").agg(F.sum("value").alias("value"), F.sum("shared").alias("shared"))
    a = groups.select("gid", "lang", "source", F.col("rest").alias("p"), "v")
    b = groups.select(F.col("gid").alias("peer"), F.col("source").alias("item"), F.col("rest").alias("q"))
    neither = F.when(F.col("v") > F.col("shared"), (F.col("v") - F.col("shared")) * F.expr("((p - q) * (p - q)) div q")).otherwise(F.lit(0))
    pairs = pairs.join(a, "gid").join(b, "peer").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + neither).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "tid"))
    best = found.where("tid IS NOT NULL").select("gid", "tid", "value").withColumn("rank", rank).where(F.col("rank") <= top)
    best = best.join(terms.select("tid", F.col("term").alias("item")), "tid").join(groups.select("gid", "lang", "source"), "gid")
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op13_source_divergence(spark, sf_dir):
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT DISTINCT lang, source FROM d),
     w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     c AS (SELECT id, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
     k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= 3),
     kl AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
     s AS (SELECT lang, source, term, sum(n) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
     sn AS (SELECT lang, source, sum(n) AS n FROM s GROUP BY 1, 2),
     p AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS cnt,
                  (1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 1)) // (coalesce(sn.n, 0) + kl.v))::HUGEINT AS p,
                  (1 + (1000000000::HUGEINT * (k.n + 1)) // (kl.n + kl.v))::HUGEINT AS q
           FROM g JOIN k USING (lang) JOIN kl USING (lang) LEFT JOIN s USING (lang, source, term) LEFT JOIN sn USING (lang, source)),
     f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE cnt > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""

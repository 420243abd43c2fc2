"""How far the sources of a language differ in their words, by count-level bitmaps.

Terms get places in blocks of about BLOCK terms. For each block, source and
count there is a bitmap of the terms that this source has so many times. AND
and a population count give how many terms two sources have with each pair of
counts; such a cell is multiplied by the difference of the two shares. Terms
that one source lacks are had by complement: with H the terms of a by count,
and z the share of a term that a source lacks,

    sum over terms |p - q| = sum over joint cells n * (|p - q| - |p - z_b| - |z_a - q| + |z_a - z_b|)
        + sum over H_a |p - z_b| + sum over H_b |z_a - q| + (V - |a| - |b|) * |z_a - z_b|

All of it is exact integers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import chunks
from .common import discard, stored, text_of, with_facts

#: Documents of a language that have a term, at least; units of a share; what is added to each count.
LEAST_DOCS, UNITS, PRIOR = 30, 1_000_000_000, 5
#: Terms of a source that are reported.
TOP = 50
#: Shares of a tile that one task holds, about.
SHARES = 2_000
#: Terms of a block, about; sources of a tile, about; different terms that a task counts before it hands them on.
BLOCK, TILE, HELD = 512, 48, 300_000
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of docs (lang, source, text), over whole texts.

    Counted within each task first. A pair of lang and source has an empty term
    with count 0 besides, so that none without terms is lost.
    """

    def handed(held):
        rows = [(lang, source, term, n, docs_with[term]) for (lang, source), (counts, docs_with) in held.items() for term, n in counts.items()]
        rows += [(lang, source, b"", 0, 0) for lang, source in held]
        for i in range(0, len(rows), 50_000):
            cols = list(zip(*rows[i : i + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["lang", "source", "term", "count", "docs"])

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                lowered = data.tobytes().translate(LOWERED)
                edge = offsets.tolist()
                for k, group in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())):
                    terms = lowered[edge[k] : edge[k + 1]].split()
                    counts, docs_with = held.setdefault(group, (Counter(), Counter()))
                    counts.update(terms)
                    docs_with.update(set(terms))
                if sum(len(c) for c, _ in held.values()) > HELD:
                    yield from handed(held)
                    held = {}
        yield from handed(held)

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, total: str, v: str) -> Column:
    """1 + floor(UNITS * (count + PRIOR) / (total + PRIOR * v)), null where there are no terms; exact for any long."""
    return F.expr(f"1 + (cast({UNITS} as decimal(10,0)) * (cast({count} as decimal(19,0)) + {PRIOR})) div nullif(cast({total} as decimal(19,0)) + {PRIOR} * cast({v} as decimal(18,0)), 0)")


def placed_terms(counted: DataFrame) -> DataFrame:
    """(lang, term, mag, block, bit, q) of the terms that LEAST_DOCS documents of lang have; q is lang's share.

    mag is the magnitude of the count: a block holds terms of one, so that it has few different counts.
    """
    kept = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    kept = stored(kept.select("lang", "term", "total", F.floor(F.log2("total")).cast("int").alias("mag")), "kept")
    sizes = kept.groupBy("lang", "mag").agg(F.count("*").alias("n"), F.sum("total").alias("part"))
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("v"), F.sum("part").alias("all"))
    sizes = sizes.join(langs, "lang").select("lang", "mag", "n", F.ceil(F.col("n") / BLOCK).alias("blocks"), "v", "all")
    placed = with_facts(kept, sizes, ["lang", "mag"], "term").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    bit = F.row_number().over(Window.partitionBy("lang", "mag", "block").orderBy("term")) - 1
    return placed.select("lang", "term", "mag", "block", bit.alias("bit"), share("total", "all", "v").alias("q"), "v")


def bitmaps(had: DataFrame) -> DataFrame:
    """(lang, mag, block, source, count, size, bits) of had (lang, mag, block, source, count, bit)."""

    def run(rows):
        table = rows.select(["source", "count", "bit"]).sort_by([("source", "ascending"), ("count", "ascending")])
        source, count, bit = table.column("source").combine_chunks().dictionary_encode(), table.column("count").to_numpy(), table.column("bit").to_numpy()
        code = source.indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (count[1:] != count[:-1])]))
        level = np.repeat(np.arange(len(first)), np.diff([*first, len(bit)]))
        flags = np.zeros((len(first), (int(bit.max()) // 64 + 1) * 64), bool)
        flags[level, bit] = True
        packed = np.packbits(flags, axis=1, bitorder="little")
        fixed = [pa.array([rows.column(c)[0].as_py()] * len(first), t) for c, t in (("lang", pa.string()), ("mag", pa.int32()), ("block", pa.int64()))]
        return pa.table([*fixed, source.take(pa.array(first)).cast(pa.string()), pa.array(count[first]), pa.array(flags.sum(1).astype(np.int64)), pa.array([x.tobytes() for x in packed], pa.binary())], ["lang", "mag", "block", "source", "count", "size", "bits"])

    return had.groupBy("lang", "mag", "block").applyInArrow(run, "lang string, mag int, block long, source string, count long, size long, bits binary")


def tiled(rows: DataFrame) -> DataFrame:
    """rows, of which each has a tile of its source, once for each pair (ta, tb) that the tile is of."""
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    return rows.select("*", other).withColumn("ta", F.least("tile", "other")).withColumn("tb", F.greatest("tile", "other")).drop("other", "tiles")


def pairs_of(sources: list[str], tile: np.ndarray, ta: int, tb: int):
    """Pairs of places in sources, each pair of sources in one order: all of a tile, or across two."""
    for i in range(len(sources)):
        for j in range(i + 1, len(sources)):
            if ta == tb or tile[i] != tile[j]:
                yield (i, j) if sources[i] < sources[j] else (j, i)


PAIRS = "lang string, a string, b string, value long"


def as_pairs(lang: str, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.table([pa.array([lang] * len(rows), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "a", "b", "value"])


def joint_cells(levels: DataFrame) -> DataFrame:
    """What the joint cells of each block add to each pair of sources; levels: bitmaps with p, z, tile and tiles."""

    def run(key, rows):
        rows = rows.sort_by("source")
        lang, ta, tb = key[0].as_py(), key[3].as_py(), key[4].as_py()
        source = rows.column("source").combine_chunks().dictionary_encode()
        code = source.indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        edge = [*first.tolist(), len(code)]
        names = [source.dictionary[int(c)].as_py() for c in code[first]]
        packed = rows.column("bits").to_pylist()
        width = max(len(x) for x in packed)
        bits = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in packed), np.uint64).reshape(len(packed), -1)
        p, z, tile = (rows.column(c).to_numpy() for c in ("p", "z", "tile"))
        out = []
        for i, j in pairs_of(names, tile[first], ta, tb):
            a, b = slice(edge[i], edge[i + 1]), slice(edge[j], edge[j + 1])
            n = np.bitwise_count(bits[a][:, None, :] & bits[b][None, :, :]).sum(axis=2, dtype=np.int64)
            pa_, pb, za, zb = p[a][:, None], p[b][None, :], z[edge[i]], z[edge[j]]
            out.append((names[i], names[j], int((n * (np.abs(pa_ - pb) - np.abs(pa_ - zb) - np.abs(za - pb) + abs(za - zb))).sum())))
        return as_pairs(lang, out)

    return tiled(levels).groupBy("lang", "mag", "block", "ta", "tb").applyInArrow(run, PAIRS)


def complements(histograms: DataFrame, sources: DataFrame) -> DataFrame:
    """What is left of each pair's sum: the terms of one side against a lacking one, and those that both lack.

    histograms: lang, source, p, size, tile, tiles, parts; sources: lang, source, z, v, had, tile, tiles, parts, had being
    the terms that it has. The shares of a pair of tiles are dealt out to parts, each of which has all the sources.
    """
    none = F.lit(None).cast("long")
    part = F.pmod(F.xxhash64("source", "p"), "parts").cast("int").alias("part")
    rows = histograms.select("lang", "source", "p", "size", none.alias("z"), none.alias("v"), none.alias("had"), "tile", "tiles", part)
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    rows = rows.unionByName(sources.select("lang", "source", none.alias("p"), none.alias("size"), "z", "v", "had", "tile", "tiles", parts))

    def run(key, rows):
        lang, ta, tb, part = (k.as_py() for k in key)
        told = rows.filter(pc.is_null(rows.column("size"))).sort_by("source")
        names = told.column("source").to_pylist()
        z, v, had, tile = (told.column(c).to_numpy() for c in ("z", "v", "had", "tile"))
        at = {s: k for k, s in enumerate(names)}
        own = rows.filter(pc.is_valid(rows.column("size")))
        place = np.array([at[s] for s in own.column("source").to_pylist()], np.int64)
        order = np.argsort(place, kind="stable")
        edge = np.searchsorted(place[order], np.arange(len(names) + 1))
        p, size = (own.column(c).to_numpy()[order] for c in ("p", "size"))
        against = lambda i, j: int((size[edge[i] : edge[i + 1]] * np.abs(p[edge[i] : edge[i + 1]] - z[j])).sum())
        return as_pairs(lang, [(names[i], names[j], against(i, j) + against(j, i) + (0 if part else int((v[i] - had[i] - had[j]) * abs(z[i] - z[j])))) for i, j in pairs_of(names, tile, ta, tb)])

    return tiled(rows).groupBy("lang", "ta", "tb", "part").applyInArrow(run, PAIRS)


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one of its lang, and its terms.

    part pair: item is another source of the lang, value the sum over the
    lang's terms of the differences of shares. part term: the top terms whose
    share in the source is above that in the lang. Null lang, source and text
    are the empty string, and so are one group with empty ones. A lang without
    a term in LEAST_DOCS documents has pairs of value 0. Ties rank by the UTF-8
    of the item; repeated rows count repeatedly; texts are counted whole
    however long; other columns aren't read, and no rows give none.
    """
    narrow = docs.select(text_of(F.col(lang)).alias("lang"), text_of(F.col(source)).alias("source"), text_of(F.col(text)).alias("text"))
    counted = stored(term_counts(narrow), "counted")
    terms = stored(placed_terms(counted), "terms")
    had = stored(counted.where("term <> ''").drop("docs").join(terms.drop("v"), ["lang", "term"]), "had")
    levels = stored(bitmaps(had), "levels")
    groups = counted.groupBy("lang", "source").agg(F.lit(0).alias("_"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).join(terms.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    totals = levels.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("size")).alias("total"), F.sum("size").alias("had"), F.count("*").alias("n_levels"))
    # Two tiles have so many shares at most, on average.
    parts = (F.floor(F.sum("n_levels") * 2 / (F.max("tiles") * SHARES)) + 1).cast("int")
    langs = langs.join(totals.join(langs, "lang").groupBy("lang").agg(parts.alias("parts")), "lang", "left").na.fill(1, ["parts"])
    facts = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").na.fill(0, ["total", "had", "n_levels", "v"])
    facts = facts.withColumn("z", F.coalesce(share("0", "total", "v"), F.lit(0).cast("long"))).withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    facts = stored(facts.select("lang", "source", "total", "had", "n_levels", "v", "z", "tile", "tiles", "parts"), "facts")
    p = share("count", "total", "v")
    known = facts.select("lang", "source", "total", "v", "z", "tile", "tiles", "parts", F.col("n_levels").alias("n"))
    shared = with_facts(levels, known, ["lang", "source"], "bits").withColumn("p", p).drop("total", "v")
    shared = stored(shared, "shared")
    histograms = shared.groupBy("lang", "source", "p", "tile", "tiles", "parts").agg(F.sum("size").alias("size"))
    both = joint_cells(shared).unionByName(complements(histograms, facts)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"), "value").select("lang", "e.*", "value")
    above = with_facts(had, facts.select("lang", "source", "total", "v", F.col("had").alias("n")), ["lang", "source"], "term").withColumn("value", p - F.col("q"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = above.where("value > 0").select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    both = both.withColumn("rank", F.row_number().over(ranked))
    out = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, df in (("pair", both), ("term", told))]
    discard(counted, terms, levels)
    return out[0].unionByName(out[1])


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
o AS (SELECT rid, lang, source, term, count(*) AS c FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(c) AS c FROM o GROUP BY lang, term HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
s AS (SELECT lang, source, term, sum(o.c) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(s.c, 0) AS c, k.c AS lc FROM g JOIN k ON g.lang = k.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
n AS (SELECT lang, source, sum(c) AS n FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, term, c, 1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (n.n + 5 * v.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (lc + 5)) // (v.n + 5 * v.v) AS q
  FROM x JOIN n ON n.lang = x.lang AND n.source = x.source JOIN v ON v.lang = x.lang),
t AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN t ON t.lang = a.lang AND t.source = a.source AND t.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

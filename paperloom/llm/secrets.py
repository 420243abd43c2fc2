"""Secret scan with corpus-wide ownership frequency, in DataFrame operations.

Each text is scanned where it lies; only small candidate rows (a value's hash,
owner, repository, span) are shuffled. A value that several owners hold, or
many repositories of one or two owners, is an example that was copied around;
one that few repositories of an owner or two hold looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of, with_facts

# The base kinds in their order, with their patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# What is added when one owner alone has it, vendor formats and long opaque runs.
OPAQUE = r"[A-Za-z0-9+/_-]{32,}"
ADDED = (
    r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|" + OPAQUE
)
KINDS = ("assign", "access", "hex", "owned")
MIN_ASSIGNED = 6
#: From so many distinct owners on, a value is a copied example.
EXAMPLE_OWNERS = 3
#: From so many distinct repositories on it is one too, whoever owns them.
EXAMPLE_REPOS = 4


def matches(pattern: str) -> tuple[Column, Column]:
    """All matches in column t, and the pieces of t between them."""
    found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    return found, F.when(F.size(found) > 0, F.split("t", pattern, -1)).otherwise(F.array().cast("array<string>"))


def spans(kind: int, m: str, g: str, value) -> Column:
    """Spans of the matches m between the pieces g, in code points."""
    step = lambda acc, k: F.struct(
        (acc["at"] + F.length(F.get(g, k)) + F.length(F.get(m, k))).alias("at"),
        F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + F.length(F.get(g, k))).alias("start"), F.lit(kind).alias("kind"),
            (acc["at"] + F.length(F.get(g, k)) + F.length(F.get(m, k))).alias("end"), value(F.get(m, k)).alias("value"),
        ))).alias("out"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(m) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), start, step)["out"]).otherwise(none)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the arrays ``base`` and ``added`` of spans (start, kind, end, value).

    Text columns named base or added are replaced. A null text is empty.
    """
    spare = [c for c in docs.columns]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in spare]).alias("row"), text_of(F.col(f"`{text}`")).alias("t"))
    found = {"a": ASSIGN, "k": ACCESS, "h": HEX, "v": ADDED}
    pairs = {k: matches(p) for k, p in found.items()}
    df = df.select("row", "t", *[m.alias(f"m{k}") for k, (m, _) in pairs.items()])
    df = df.select("*", *[F.when(F.size(f"m{k}") > 0, F.split("t", p, -1)).alias(f"g{k}") for k, p in found.items()])
    whole = lambda x: x
    df = df.select(
        "row",
        F.filter(spans(0, "ma", "ga", lambda x: F.regexp_extract(x, ASSIGN, 1)), lambda s: F.length(s["value"]) >= MIN_ASSIGNED).alias("a"),
        spans(1, "mk", "gk", whole).alias("k"),
        spans(2, "mh", "gh", whole).alias("h"),
        spans(3, "mv", "gv", whole).alias("v"),
    )
    df = df.select("row", "v", F.array_sort(F.concat("a", "k", "h")).alias("base"))
    opaque = lambda s: ~s["value"].rlike(f"^{OPAQUE}$") | (s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"))
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    others = [F.col("row")[c].alias(c) for c in spare if c not in ("base", "added")]
    return df.select(*others, "base", F.filter("v", lambda s: opaque(s) & clear(s)).alias("added"))


def ownership(values: DataFrame) -> DataFrame:
    """values (digest, owner, repo) as (digest, n_found, n_repos, n_owners).

    Three partial sums in a row, so a value that a third of the corpus holds
    reaches the last one as a row for each owner and task.
    """
    by_repo = values.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: tuple = ("source", "lang")) -> DataFrame:
    """One row per row of docs: its spans and what the corpus says of them.

    Returns doc_id, text_key (xxhash64 of doc_id and text; joins back to the
    rows), base and spans (arrays of start, kind, end), n_live and n_example (spans
    whose value few or many owners and repositories hold), max_owners and max_repos
    (of any of its values). spans holds every base span and the added ones that
    look live. A null owner or repository counts as one more of them, a null text
    as empty, and the spans of a null doc_id are kept under null. Repeated rows give
    repeated results and count once for owners; very long texts are scanned whole; an
    empty table gives none. Other columns of docs aren't read, whatever their names.
    """
    c = lambda name: F.col(f"`{name}`")
    key = F.xxhash64(c(doc_id), text_of(c(text))).alias("text_key")
    rows = candidates(docs.select(c(doc_id).alias("doc_id"), key, text_of(c(text)).alias("t0"), c(owner).alias("owner"), F.concat_ws("/", *[F.coalesce(c(x).cast("string"), F.lit("?")) for x in repo]).alias("repo")), "t0")
    hashed = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("digest")))
    rows = stored(rows.select("doc_id", "text_key", "owner", "repo", hashed("base").alias("base"), hashed("added").alias("added")), "candidates")
    found = rows.select("doc_id", "text_key", "owner", "repo", F.explode(F.concat("base", "added")).alias("s"))
    found = found.select("doc_id", "text_key", "owner", "repo", "s.*")
    live = (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("n_repos") < EXAMPLE_REPOS)
    verdict = stored(ownership(found.select("digest", "owner", "repo")).select("*", live.alias("live")), "ownership")
    judged = with_facts(found.select("doc_id", "text_key", "start", "kind", "end", "digest"), verdict, ["digest"], "text_key", n="n_found")
    span = F.struct("start", "kind", "end")
    judged = judged.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.when((F.col("kind") < 3) | F.col("live"), span))).alias("spans"),
        F.size(F.collect_set(F.when(F.col("live"), span))).cast("long").alias("n_live"),
        F.size(F.collect_set(F.when(~F.col("live"), span))).cast("long").alias("n_example"),
        F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"),
    ).withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = rows.select("doc_id", "text_key", bare.alias("base"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return base.join(judged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select(
        "doc_id", "text_key", "base", F.coalesce("spans", none).alias("spans"), *map(zero, ("n_live", "n_example", "max_owners", "max_repos")),
    )


def spelled(array: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts by base kind, a hash and all spans."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"), "n_live", "n_example", "max_owners", "max_repos")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """docs with each span of find_secrets replaced by [KIND], its columns kept, whatever their names.

    Overlapping spans are replaced as one, named after the first. Rows without
    a secret are untouched, null texts too. Column n_chars, if named, is set to the new
    length where the text changed. Repeated rows stay repeated.
    """
    c = lambda name: F.col(f"`{name}`")
    rows = docs.select(F.xxhash64(c(doc_id), text_of(c(text))).alias("key"), c(text).alias("t"), F.struct(*[c(x) for x in docs.columns]).alias("row"))
    found = find_secrets(docs, doc_id, text).where(F.size("spans") > 0).select(F.col("text_key").alias("key"), F.col("spans").alias("s")).dropDuplicates(["key"])
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring("t", acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"),
    )
    end = lambda acc: F.concat(acc["out"], F.substring("t", acc["at"] + 1, F.length("t")))
    new = F.aggregate("s", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)
    rows = rows.join(found, "key", "left").select("row", F.when(F.col("s").isNotNull(), new).alias("new"))
    changed = {text: F.col("new")} | ({n_chars: F.length("new").cast(docs.schema[n_chars].dataType)} if n_chars else {})
    return rows.select(*[(F.when(F.col("new").isNotNull(), changed[x]).otherwise(F.col("row")[x]) if x in changed else F.col("row")[x]).alias(x) for x in docs.columns])


_SQL_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _sql_kind(name: str, kind: int, pattern: str, value: str) -> str:
    return rf"""{name} AS (SELECT rid, k, {kind} AS kind, m[k] AS s, {value} AS value,
  coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT rid, m, g, unnest(range(1, len(m) + 1)) AS k FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d)))"""


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
{_sql_kind("s0", 0, _SQL_ASSIGN, f"regexp_extract(m[k], '{_SQL_ASSIGN}', 2)")},
{_sql_kind("s1", 1, ACCESS, "m[k]")},
{_sql_kind("s2", 2, HEX, "m[k]")},
{_sql_kind("s3", 3, ADDED, "m[k]")},
b AS (SELECT rid, a, kind, a + length(s) AS z, value FROM (SELECT * FROM s0 WHERE length(value) >= 6 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)),
v AS (SELECT rid, a, kind, a + length(s) AS z, value FROM s3 WHERE (NOT regexp_full_match(value, '{OPAQUE}') OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')))
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = s3.rid AND b.a < s3.a + length(s3.s) AND s3.a < b.z)),
c AS (SELECT * FROM b UNION ALL SELECT * FROM v),
o AS (SELECT value, n_owners, n_repos, n_owners < {EXAMPLE_OWNERS} AND n_repos < {EXAMPLE_REPOS} AS live FROM (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS n_owners,
  count(DISTINCT coalesce(source, chr(0)) || chr(0) || coalesce(source, '?') || '/' || coalesce(lang, '?')) AS n_repos FROM c JOIN d USING (rid) GROUP BY value)),
n AS (SELECT rid, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex,
  string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || a || ':' || z, ',' ORDER BY a, kind) AS base FROM b GROUP BY rid),
w AS (SELECT rid, string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || z, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR live) AS spans, count_if(live) AS n_live, count_if(NOT live) AS n_example, max(n_owners) AS max_owners, max(n_repos) AS max_repos
  FROM c JOIN o USING (value) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(max_owners, 0) AS max_owners, coalesce(max_repos, 0) AS max_repos
FROM d LEFT JOIN n USING (rid) LEFT JOIN w USING (rid)
"""

"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Base spans come from three patterns. Each base match yields a candidate value (the assigned value, the
access key, the hex run), which is hashed at once; values never leave this module. Hashes are counted over
the whole corpus by distinct repositories and owners: a value that many owners or many repositories carry is a copied
example (``example`` spans), one that a single owner carries in few repositories and that looks random is live-looking (``live``).
Those spans are added to the base ones.

Here a document's repository is its source and language, its owner its source; both are parameters.

A match's place is a running sum over the lengths of the text before each match and of the matches, taken over rows, so
the work is linear in the matches of a document. A value's counts reach its matches by :func:`common.spread_join`, so those of a value that a third of
the corpus carries stay spread over all tasks.

Nulls: a null text is empty; null repositories or owners count as one value. Repeated rows are scanned
each for itself. A document without matches keeps empty spans, an empty table gives an empty result, extra columns of any name
aren't read. All positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Patterns and least lengths of the base kinds. A run that is too short for `access` or `hex`
# can hold no longer match, so their least length is part of the pattern; a short `assign` match still
# consumes its text and is dropped afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "live", "example")

#: A value with at least so many owners, or in so many repositories, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 4
#: A live-looking value has at least so many characters and distinct characters, and a digit.
LIVE_LENGTH, LIVE_DISTINCT = 16, 8


def _found(kind: str, pattern: str, group: int) -> Column:
    """array<struct<kind, no, gap, n, size, hash, live>> of a pattern's leftmost matches: code points before it, of it and of its value."""
    text = F.col("_text")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # zipped first: inside the function of an array every other array would be made again for each element
    zipped = F.slice(F.arrays_zip(whole.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("gap")), F.lit(1), F.size(whole))
    one = lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("no"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("n"), F.length(x["v"]).alias("size"), F.sha2(x["v"], 256).alias("hash"), _looks_live(x["v"]).alias("live"))
    empty = F.expr("cast(array() as array<struct<kind:int,no:int,gap:int,n:int,size:int,hash:string,live:boolean>>)")
    return F.when(text.rlike(pattern), F.transform(zipped, one)).otherwise(empty)


def matches(rows: DataFrame) -> DataFrame:
    """Base spans (row, repo, owner, kind, start, end, from, hash, live) of rows (row, repo, owner, found); ``from``: where the value starts."""
    each = rows.filter(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("x")).select("row", "repo", "owner", "x.*")
    before = Window.partitionBy("row", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(before).cast("int"))
    each = each.filter((F.col("kind") != KINDS.index("assign")) | (F.col("size") >= LEAST_ASSIGNED))
    return each.select("row", "repo", "owner", "kind", (F.col("end") - F.col("n")).alias("start"), "end", (F.col("end") - F.col("size")).alias("from"), "hash", "live")


def _looks_live(value: Column) -> Column:
    return (F.length(value) >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT) & value.rlike("[0-9]") & ~value.rlike("(?i)example|sample|dummy|placeholder|changeme")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_docs, n_repos, n_owners), n_docs being the rows, from rows (hash, repo, owner).

    Each value's rows collapse to one a repository before the distinct counts, so a value that a third
    of the corpus carries moves as few rows as there are repositories.
    """
    repos = candidates.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("n_repos"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_docs"), F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base (spans), verdicts (added spans)."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.coalesce(owner.cast("string"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if repo is None else repo
    rows = docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("_text"), repo.alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"))
    found = F.concat(_found("assign", ASSIGN, 2), _found("access", ACCESS, 0), _found("hex", HEX, 0))
    rows = common.store(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "repo", "owner", found.alias("found")), "secrets")
    each = common.store(matches(rows), "secret-spans")
    counts = common.store(ownership(each.select("hash", "repo", "owner")), "secret-owners")
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS)
    kind = F.when(copied, KINDS.index("example")).when((F.col("n_owners") == 1) & F.col("live"), KINDS.index("live"))
    judged = common.spread_join(each, counts, "hash", "n_docs").withColumn("verdict", kind)
    span = F.struct("start", "kind", "end")
    added = F.when(F.col("verdict").isNotNull(), F.struct(F.col("from").alias("start"), F.col("verdict").cast("int").alias("kind"), "end"))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("base"), F.array_sort(F.collect_set(added)).alias("verdicts"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    out = rows.select("doc_id", "row").join(spans, "row", "left").withColumns({"base": F.coalesce("base", none), "verdicts": F.coalesce("verdicts", none)})
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), "base", "verdicts")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.documents(spark, sf_dir))
    number = lambda k: F.size(F.filter("verdicts", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "verdicts"))).alias("spans"),
        number("live"), number("example"),
    )


def _found_sql(kind: int, pattern: str, group: int) -> str:
    """Base matches of one kind as rows (doc_id, repo, owner, start_, kind, end_, from_, value)."""
    p = pattern.replace("'", "''")
    values = f"regexp_extract_all(text, '{p}', {group})" if group else "m"
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, repo, owner, s AS start_, {kind} AS kind, s + length(m[i]) AS end_, s + length(m[i]) - length(v[i]) AS from_, v[i] AS value
      FROM (SELECT *, {size("p[1:i]")} + {size("m[1:i - 1]")} AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT *, {values} AS v, regexp_split_to_array(text, '{p}') AS p FROM (SELECT *, regexp_extract_all(text, '{p}') AS m FROM t))))"""


_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_JOINED = f"array_to_string(list_transform(list_sort({{}}), lambda q: {_NAMES}[q.kind + 1] || ':' || q.s || ':' || q.e), ',')"
SQL5 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
base AS ({_found_sql(0, ASSIGN, 2)} WHERE length(v[i]) >= {LEAST_ASSIGNED} UNION ALL {_found_sql(1, ACCESS, 0)} UNION ALL {_found_sql(2, HEX, 0)}),
own AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM base GROUP BY value),
judged AS (SELECT DISTINCT doc_id, from_, end_, CASE WHEN owners >= {EXAMPLE_OWNERS} OR repos >= {EXAMPLE_REPOS} THEN {KINDS.index("example")} WHEN owners = 1 AND length(value) >= {LIVE_LENGTH} AND len(list_distinct(string_split(value, ''))) >= {LIVE_DISTINCT}
  AND regexp_matches(value, '[0-9]') AND NOT regexp_matches(value, '(?i)example|sample|dummy|placeholder|changeme') THEN {KINDS.index("live")} END AS kind FROM base JOIN own USING (value)),
b AS (SELECT doc_id, list({{'s': start_, 'kind': kind, 'e': end_}}) AS x, sum((kind = 0)::INT) AS a, sum((kind = 1)::INT) AS c, sum((kind = 2)::INT) AS h FROM base GROUP BY doc_id),
v AS (SELECT doc_id, list({{'s': from_, 'kind': kind, 'e': end_}}) AS y, sum((kind = 3)::INT) AS l, sum((kind = 4)::INT) AS m FROM judged WHERE kind IS NOT NULL GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce({_JOINED.format("x")}, '')) AS base_sha256,
  coalesce({_JOINED.format("list_concat(x, coalesce(y, []))")}, '') AS spans, coalesce(l, 0)::BIGINT AS n_live, coalesce(m, 0)::BIGINT AS n_example
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN v USING (doc_id)
"""

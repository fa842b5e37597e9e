"""Queries of the subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.tokens import DBA_PATTERN
from tallyweave.llm.components import merged_groups
from tallyweave.llm.leaks import find_leaks
from tallyweave.llm.matching import found_pairs, match_records
from tallyweave.llm.packing import pack_texts
from tallyweave.llm.pii import find_personal_information, redact_personal_information
from tallyweave.llm.survivorship import record_survivors, target_survivors
from tallyweave.llm.topn import top_n
from tallyweave.llm.variants import found_variants, link_spellings


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_pairs(match_records(_read(spark, sf_dir, "records")).groups)


def p1_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate pair with the probability that the two records are one company."""
    pairs = match_records(_read(spark, sf_dir, "records")).pairs
    return pairs.select(F.col("a").alias("record_a"), F.col("b").alias("record_b"), F.round("posterior", 6).alias("posterior"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _read(spark, sf_dir, "targets")
    latest = F.max(F.struct("scored_at", "target_id", "composite", F.upper(F.trim("state")).alias("state"), F.lower(F.trim("segment")).alias("segment")))
    current = targets.groupBy("thesis_id", "company_id").agg(latest.alias("r"))
    rows = current.select("thesis_id", "company_id", "r.composite", "r.state", "r.segment").dropna(subset=["state", "segment"])
    best = top_n(rows, ["thesis_id", "state", "segment"], "composite", [F.col("company_id")], 3)
    return best.select("thesis_id", "state", "segment", "place", "company_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_groups(_read(spark, sf_dir, "review_queue"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = merged_groups(_read(spark, sf_dir, "review_queue"))
    specs = _read(spark, sf_dir, "source_specs")
    of_records = record_survivors(_read(spark, sf_dir, "records"), groups, specs)
    of_targets = target_survivors(_read(spark, sf_dir, "targets"), specs)
    return of_records.unionByName(of_targets)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _read(spark, sf_dir, "review_queue")
    return found_variants(link_spellings(_read(spark, sf_dir, "records"), queue), queue)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(_read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_information(_read(spark, sf_dir, "documents"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders."""
    return redact_personal_information(_read(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_posteriors": p1_posteriors,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_packed": p7_packed,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

GROUPS_SQL = """
latest AS (
  SELECT least(record_a, record_b) AS low, greatest(record_a, record_b) AS high, arg_max(coalesce(decision, ''), seq) AS decision
  FROM review_queue WHERE record_a <> record_b GROUP BY 1, 2),
e AS (SELECT low, high FROM latest WHERE lower(trim(decision)) = 'merge'),
both_ways AS (SELECT low AS a, high AS b FROM e UNION ALL SELECT high, low FROM e),
reach(node, seen) AS (
  SELECT a, a FROM both_ways UNION SELECT b, b FROM both_ways
  UNION
  SELECT x.b, r.seen FROM reach r JOIN both_ways x ON x.a = r.node WHERE r.seen < x.b),
grp AS (SELECT node AS record_id, min(seen) AS group_id FROM reach GROUP BY node)
"""

_PHONE = r"regexp_replace(regexp_replace(regexp_replace(lower(phone), '\s*(x|ext\.?|extension|#)\s*\d+\s*$', ''), '[^0-9]', '', 'g'), '^1(\d{10})$', '\1')"
_HOST = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(website)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^.*@', ''), ':\d*$', ''), '^\.+|\.+$', '', 'g')"""
_STAND_IN = "coalesce(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) IN ('', 'n a', 'na', 'name not provided', 'no name', 'none', 'not provided', 'null', 'see file', 'tbd', 'unknown'), true)"
_LEGAL_PART = rf"""trim(regexp_replace(trim(regexp_replace(trim(name), '{DBA_PATTERN}.*$', '')), '\s*\([^()]*\)\s*$', ''))"""
_LEGAL_END = rf"""regexp_extract(replace(lower({_LEGAL_PART}), '.', ''), '([a-z]+)[\s,;]*$', 1) IN ('co', 'company', 'corp', 'corporation', 'inc', 'incorporated', 'limited', 'llc', 'llp', 'lp', 'ltd', 'pc', 'plc', 'pllc')"""
_ZIP = "left(regexp_replace(zip, '[^0-9]', '', 'g'), 5)"
_FEED = r"regexp_replace(lower(trim({0})), '[\s_-]+', '_', 'g')"

ORACLE = {
    "p2_found": """
WITH one AS (
  SELECT thesis_id, company_id, composite, upper(trim(state)) AS state, lower(trim(segment)) AS segment,
         row_number() OVER (PARTITION BY thesis_id, company_id ORDER BY scored_at DESC NULLS LAST, target_id DESC) AS r
  FROM targets),
ok AS (SELECT * FROM one WHERE r = 1 AND composite IS NOT NULL AND NOT isnan(composite) AND state IS NOT NULL AND segment IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY thesis_id, state, segment ORDER BY composite DESC, company_id) AS place FROM ok)
SELECT thesis_id, state, segment, CAST(place AS INTEGER) AS place, company_id FROM p WHERE place <= 3""",
    "p3_found": f"WITH RECURSIVE {GROUPS_SQL} SELECT record_id, group_id FROM grp",
    "p4_found": f"""
WITH RECURSIVE {GROUPS_SQL},
t AS (SELECT {_FEED.format('feed')} AS feed, max(trust) AS trust FROM source_specs GROUP BY 1),
f AS (
  SELECT DISTINCT g.group_id, r.record_id, coalesce(t.trust, 0.5) AS trust, r.observed_at,
    NOT {_STAND_IN.format('name')} AS n_ok, {_LEGAL_END} AS l_ok,
    coalesce(regexp_matches({_PHONE}, '^[2-9]\\d{{9}}$'), false) AS p_ok,
    coalesce(regexp_matches({_HOST}, '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') AND NOT regexp_matches({_HOST}, '^www\\.[a-z0-9-]+$'), false) AS w_ok,
    coalesce(length({_ZIP}) = 5 AND {_ZIP} NOT IN ('00000','11111','22222','33333','44444','55555','66666','77777','88888','99999'), false) AS z_ok
  FROM records r JOIN grp g USING (record_id) LEFT JOIN t ON t.feed = {_FEED.format('source')}),
u AS (
  SELECT group_id, 'name' AS field, record_id AS row_id, trust, observed_at AS tm FROM f WHERE n_ok
  UNION ALL SELECT group_id, 'legal_name', record_id, trust, observed_at FROM f WHERE n_ok AND l_ok
  UNION ALL SELECT group_id, 'phone', record_id, trust, observed_at FROM f WHERE p_ok
  UNION ALL SELECT group_id, 'website', record_id, trust, observed_at FROM f WHERE w_ok
  UNION ALL SELECT group_id, 'zip', record_id, trust, observed_at FROM f WHERE z_ok),
tg AS (SELECT DISTINCT company_id, target_id, name, legal_name, sources, scored_at FROM targets),
rep AS (SELECT company_id FROM tg GROUP BY 1 HAVING count(DISTINCT target_id) > 1),
ts AS (SELECT target_id, max(CASE WHEN x.feed = '' THEN 0 ELSE coalesce(t.trust, 0.5) END) AS trust
       FROM (SELECT target_id, {_FEED.format('unnest(string_split(sources, chr(59)))')} AS feed FROM tg) x LEFT JOIN t USING (feed) GROUP BY 1),
v AS (
  SELECT company_id AS group_id, 'target_name' AS field, target_id AS row_id, coalesce(ts.trust, 0) AS trust, scored_at AS tm
  FROM tg JOIN rep USING (company_id) LEFT JOIN ts USING (target_id) WHERE NOT {_STAND_IN.format('name')}
  UNION ALL
  SELECT company_id, 'target_legal_name', target_id, coalesce(ts.trust, 0), scored_at
  FROM tg JOIN rep USING (company_id) LEFT JOIN ts USING (target_id) WHERE NOT {_STAND_IN.format('legal_name')}),
a AS (SELECT * FROM u UNION ALL SELECT * FROM v)
SELECT group_id, field, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY trust DESC, tm DESC NULLS LAST, row_id) AS r FROM a) WHERE r = 1""",
}

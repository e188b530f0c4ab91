"""Queries of the general training-data operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phenorank.operators import hierarchy, units
from phenorank.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.found(spark, table(spark, sf_dir, "hpoa_annotation"), table(spark, sf_dir, "frequency_category"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.found(spark, table(spark, sf_dir, "hpo_term"))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.paths(*hierarchy.resolved_links(table(spark, sf_dir, "hpo_term")))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolved_links(table(spark, sf_dir, "hpo_term"))[1])


_ALT = "|".join(alias for alias, _, _ in units.UNIT_ALIASES if alias not in ("per_10k", "ratio", "proportion", "fraction", "share"))

P2_SQL = f"""
WITH units(alias, factor) AS (VALUES {", ".join(f"('{a}', {f!r}::DOUBLE)" for a, f, _ in units.UNIT_ALIASES)}),
cleaned AS (
  SELECT annotation_id,
    regexp_replace(trim(regexp_replace(lower(frequency_raw), '\\s+', ' ', 'g')), '{units.ABOUT}', '') AS t,
    lower(trim(frequency_kind)) AS kind
  FROM (SELECT annotation_id, frequency_kind,
          translate(frequency_raw, '０１２３４５６７８９％．，／－', '0123456789%.,/-') AS frequency_raw
        FROM hpoa_annotation WHERE frequency_raw IS NOT NULL AND annotation_id IS NOT NULL)
),
classes AS (
  SELECT lower(code) AS name, share_ppm FROM frequency_category
  UNION ALL SELECT lower(label), share_ppm FROM frequency_category
  UNION ALL SELECT lower(label_vi), share_ppm FROM frequency_category
),
by_class AS (
  SELECT annotation_id, share_ppm::DOUBLE / 1000000 AS share
  FROM cleaned JOIN classes ON name = coalesce(nullif(regexp_extract(t, '(hp:[0-9]{{7}})', 1), ''), t)
),
cut AS (
  SELECT annotation_id, kind,
    CASE WHEN regexp_matches(t, '{units.RANGE}') THEN 'range' WHEN regexp_matches(t, '{units.RATIO}') THEN 'ratio'
         WHEN regexp_matches(t, '{units.SINGLE}') THEN 'single' END AS form,
    CASE WHEN regexp_matches(t, '{units.RANGE}') THEN regexp_extract(t, '{units.RANGE}', 1)
         WHEN regexp_matches(t, '{units.RATIO}') THEN regexp_extract(t, '{units.RATIO}', 1)
         ELSE regexp_extract(t, '{units.SINGLE}', 1) END AS a,
    CASE WHEN regexp_matches(t, '{units.RANGE}') THEN regexp_extract(t, '{units.RANGE}', 3)
         WHEN regexp_matches(t, '{units.RATIO}') THEN regexp_extract(t, '{units.RATIO}', 2) END AS b,
    coalesce(nullif(regexp_extract(t, '({_ALT})$', 1), ''), '') AS named
  FROM cleaned WHERE annotation_id NOT IN (SELECT annotation_id FROM by_class)
),
numbers AS (
  SELECT *,
    CASE WHEN regexp_matches(a, '^[1-9][0-9]{{0,2}}(,[0-9]{{3}})+$') THEN try_cast(replace(a, ',', '') AS DOUBLE) END AS a_thousands,
    try_cast(replace(a, ',', '.') AS DOUBLE) AS ad,
    try_cast(replace(b, ',', '.') AS DOUBLE) AS bd,
    CASE WHEN form = 'ratio' THEN coalesce(try_cast(regexp_replace(b, '[., ]([0-9]{{3}})', '\\1', 'g') AS DOUBLE), try_cast(replace(b, ',', '.') AS DOUBLE)) END AS whole
  FROM cut WHERE form IS NOT NULL
),
factored AS (
  SELECT n.*, coalesce(tu.factor, ku.factor, CASE WHEN coalesce(bd, ad) <= 1 THEN 1 ELSE 0.01 END) AS f
  FROM numbers n LEFT JOIN units tu ON tu.alias = n.named LEFT JOIN units ku ON ku.alias = n.kind
),
shares AS (
  SELECT annotation_id, share FROM by_class
  UNION ALL
  SELECT annotation_id, CASE
    WHEN form = 'ratio' THEN CASE WHEN whole > 0 THEN coalesce(a_thousands, ad) / whole END
    WHEN form = 'range' THEN (ad * f + bd * f) / 2
    ELSE coalesce(CASE WHEN a_thousands * f <= 1 THEN a_thousands END, ad) * f END
  FROM factored
)
SELECT DISTINCT annotation_id, CAST(round(least(share, 1) * 1000000) AS BIGINT) AS share_ppm FROM shares WHERE share IS NOT NULL
"""

_LINKS = """
WITH RECURSIVE ids AS (
  SELECT DISTINCT upper(trim(hpo_id)) AS id, coalesce(is_obsolete, false) AS gone, upper(trim(replaced_by)) AS replaced, parents, alt_ids FROM hpo_term
),
live AS (SELECT DISTINCT id FROM ids WHERE id NOT IN (SELECT id FROM ids WHERE gone)),
alias AS (
  SELECT id AS a, min(replaced) AS b FROM ids WHERE gone GROUP BY id
  UNION ALL
  SELECT a, min(id) FROM (SELECT upper(trim(unnest(alt_ids))) AS a, id FROM ids) WHERE a NOT IN (SELECT id FROM ids) GROUP BY a
),
named AS (SELECT DISTINCT child, parent FROM (SELECT id AS child, upper(trim(unnest(parents))) AS parent FROM ids WHERE NOT gone) WHERE child IN (SELECT id FROM live)),
meant(child, parent) AS (
  SELECT child, parent FROM named
  UNION
  SELECT m.child, a.b FROM meant m JOIN alias a ON a.a = m.parent
),
links AS (SELECT DISTINCT child, parent FROM meant WHERE parent IN (SELECT id FROM live)),
"""

P3_SQL = _LINKS + """
reach(node, anc) AS (
  SELECT child, parent FROM links
  UNION
  SELECT r.node, l.parent FROM reach r JOIN links l ON l.child = r.anc
)
SELECT a.node AS hpo_id, min(a.anc) AS cycle_id FROM reach a JOIN reach b ON a.node = b.anc AND a.anc = b.node GROUP BY a.node
"""

P3_PATHS_SQL = _LINKS + """
levels(node, depth, path) AS (
  SELECT id, 0, [id] FROM live WHERE id NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT l.child, v.depth + 1, list_append(v.path, l.child) FROM levels v JOIN links l ON l.parent = v.node
  WHERE NOT list_contains(v.path, l.child)
),
shortest AS (SELECT node, depth, path, min(depth) OVER (PARTITION BY node) AS least FROM levels),
best AS (SELECT node, any_value(depth) AS depth, arg_min(path, list_reverse(path)) AS path FROM shortest WHERE depth = least GROUP BY node),
reach(node, anc) AS (
  SELECT child, parent FROM links
  UNION
  SELECT r.node, l.parent FROM reach r JOIN links l ON l.child = r.anc
)
SELECT i.id AS hpo_id, array_to_string(b.path, '/') AS path, b.depth AS depth, b.path[1] AS root,
  EXISTS (SELECT 1 FROM reach r WHERE r.node = i.id AND r.anc = i.id) AS in_cycle,
  (SELECT count(*) FROM reach r WHERE r.anc = i.id AND r.node <> i.id) AS n_descendants
FROM live i LEFT JOIN best b ON b.node = i.id
"""

P3_DESCENDANTS_SQL = _LINKS + """
reach(node, anc, dist) USING KEY (node, anc) AS (
  SELECT child, parent, 1 FROM links
  UNION
  SELECT r.node, l.parent, min(r.dist + 1) FROM reach r JOIN links l ON l.child = r.anc LEFT JOIN recurring.reach k ON k.node = r.node AND k.anc = l.parent
  WHERE k.dist IS NULL OR k.dist > r.dist + 1 GROUP BY r.node, l.parent
)
SELECT anc AS hpo_id, node AS descendant_id, dist AS distance FROM reach WHERE anc <> node
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
}

SQL: dict[str, str] = {
    "p2_found": P2_SQL,
    "p3_found": P3_SQL,
    "p3_paths": P3_PATHS_SQL,
    "p3_descendants": P3_DESCENDANTS_SQL,
}

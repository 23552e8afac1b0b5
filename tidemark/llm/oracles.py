"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from tidemark.llm import secrets
from tidemark.llm.decontamination import SHINGLE, THRESHOLD


def contaminated(n: int = SHINGLE, threshold: float = THRESHOLD) -> str:
    """Shares of the items' distinct shingles that documents hold, all items against all documents by a join on shingles."""
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
     k AS (SELECT item_id, w, least({n}, len(w)) AS k FROM i WHERE len(w) > 0),
     item AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM k)),
     d AS (SELECT doc_id, {words} AS w FROM documents),
     doc AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM item) WHERE len(w) >= k)),
     size AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id),
     hit AS (SELECT doc_id, item_id, count(*) AS hits FROM doc JOIN item USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, hits / n AS containment, n AS item_shingles FROM hit JOIN size USING (item_id) WHERE hits >= {threshold} * n - 1e-9"""


def secret_spans(rules=secrets.RULES) -> str:
    """Matches of each rule and the pieces between them give the places, as code points."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, {text(r.kind)} AS kind, regexp_extract_all(text, {text(r.pattern)}) AS hits, regexp_split_to_array(text, {text(r.pattern)}) AS gaps FROM t" + (f" WHERE contains(text, {text(r.hint)})" if r.hint else "")
        for k, r in enumerate(rules)
    )
    kept = " AND ".join(["true", *(f"(k <> {k} OR regexp_matches(hit, {text(r.kept)}))" for k, r in enumerate(rules) if r.kept)])
    base = [k for k, r in enumerate(rules) if r.base]
    shown = "string_agg(kind || ':' || start_ || ':' || (start_ + length(hit)), ',' ORDER BY start_, k)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     m AS ({each}),
     u AS (SELECT doc_id, k, kind, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
     p AS (SELECT doc_id, k, kind, hits[i] AS hit, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0))::BIGINT AS start_ FROM u),
     s AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{rules[k].kind}" for k in base)}, {shown} FILTER (k IN ({", ".join(map(str, base))})) AS base, {shown} AS spans FROM p WHERE {kept} GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{rules[k].kind}, 0) AS n_{rules[k].kind}" for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN s ON t.doc_id = s.doc_id"""

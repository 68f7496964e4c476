"""DuckDB expression text used by the oracles (same rules, independent engine)."""

from __future__ import annotations

from shapelens.functions.keys import KEY_SEPARATORS


def key_template(k: str) -> str:
    """DuckDB form of the key-template rules (1-based list indexes)."""
    def is_id(x: str) -> str:
        return (f"(regexp_full_match({x}, '[0-9]+') OR "
                f"regexp_full_match({x}, '(?i)[0-9a-f]{{6,}}') OR "
                f"regexp_full_match({x}, '(?i)[0-9a-z]{{10,}}') OR "
                f"(regexp_matches({x}, '[0-9]$') AND length({x}) > 2))")

    rules = []
    for sep in KEY_SEPARATORS:
        parts = f"string_split({k}, '{sep}')"
        idx = f"list_min([i for x, i in {parts} if i > 1 AND {is_id('x')}])"
        rules.append(
            f"CASE WHEN contains({k}, '{sep}') AND {idx} IS NOT NULL THEN "
            f"array_to_string(list_slice({parts}, 1, {idx} - 1), '{sep}') || '{sep}*' END")
    rules.append(f"CASE WHEN regexp_full_match({k}, '(?i)[a-z_]+[0-9]+') THEN "
                 f"regexp_extract({k}, '(?i)^([a-z_]+)[0-9]+$', 1) || '*' END")
    rules.append(f"CASE WHEN regexp_matches({k}, '(?i)[a-z]+[0-9a-f]{{16,}}') THEN "
                 f"regexp_replace({k}, '(?i)[0-9a-f]{{8,}}', '*', 'g') END")
    rules.append(f"CASE WHEN length({k}) > 5 THEN "
                 f"left({k}, least(5, floor(length({k}) / 2))::INT) || '*' END")
    return "coalesce(" + ", ".join(rules + [k]) + ")"


def pct(n: str, d: str) -> str:
    return f"CAST(floor({n} / {d} * 100 + 0.5) AS INTEGER)"


def json_leaf_type(t: str) -> str:
    """json_tree row (alias ``t``) -> document type name."""
    return (f"CASE {t}.type WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' "
            f"WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'OBJECT' THEN 'object' "
            f"ELSE CASE WHEN CAST({t}.atom AS DOUBLE) % 1 = 0 THEN 'number' "
            f"ELSE 'double' END END")


def json_leaves(docs_cte: str, extra: str = "") -> str:
    """(doc_id, [extra,] path, type) for every leaf of the documents in a CTE."""
    cols = f"d.doc_id, {extra + ', ' if extra else ''}"
    return (f"SELECT {cols}replace(substr(t.fullkey, 3), '\"', '') AS path, "
            f"{json_leaf_type('t')} AS type "
            f"FROM {docs_cte} d, json_tree(d.json) t "
            f"WHERE t.type <> 'OBJECT' AND t.fullkey NOT LIKE '%[%'")

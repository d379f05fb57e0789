"""DuckDB SQL for the queries: written on its own from the operators' definitions, as common table expressions."""

from __future__ import annotations

import re

from weftlink.functions.normalize import ADDRESS_WORDS, LEGAL_WORDS, SQUASH_STRONG, SQUASH_WEAK, US_STATES
from weftlink.plans.queries import PARAMS, THRESHOLD

_SEP = r"[^\p{L}\p{N}_]+"
_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _word_rule(x: str, pattern: str, to: str) -> str:
    """Replace whole words: RE2 has no look-around, so separators are taken along, and the rule runs twice."""
    rule = rf"(^|[^\p{{L}}\p{{N}}_])(?:{pattern.replace(' ', _BLANK + '+')})($|[^\p{{L}}\p{{N}}_])"
    for _ in range(2):
        x = f"regexp_replace({x}, '{rule}', '\\1{to}\\2', 'g')"
    return x


def _replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = "replace({}, '{}', '{}')".format(x, a.replace("'", "''"), b)
    return x


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_BLANK}+', ' ', 'g'))"


def _name(x: str) -> str:
    x = _replaced(f"lower({x})", [("&", " and "), (".", " "), (",", " "), ("-", " "), ("'", ""), ('"', "")])
    for w in LEGAL_WORDS:
        x = _word_rule(x, w, "")
    return _collapsed(x)


def _address(x: str) -> str:
    x = _replaced(f"lower({x})", [(",", " "), (".", " "), ("-", " ")])
    for w, full in ADDRESS_WORDS:
        x = _word_rule(x, w, full)
    return _collapsed(x)


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_BLANK}+'), lambda w: w <> '')"


def _pieces(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SEP}'), lambda w: w <> '')"


def _numbers(x: str, least: int, most: int | str = "") -> str:
    return f"list_filter({_pieces(x)}, lambda w: regexp_full_match(w, '[0-9]{{{least},{most}}}'))"


def _squash(x: str, strong: bool) -> str:
    out = _replaced(f"lower({x})", [(s, "") for s in (SQUASH_STRONG if strong else SQUASH_WEAK)])
    return f"regexp_replace({out}, '[^a-z0-9]', '', 'g')" if strong else out


def _source(x: str) -> str:
    return f"CASE WHEN {x} LIKE 'S1-%' THEN 'S1' WHEN {x} LIKE 'S2-%' THEN 'S2' ELSE 'S3' END"


def _lcs(x: str, y: str) -> str:
    """Length of the longest common subsequence of two columns whose shorter one has at most 120 characters: bits of a 128-bit integer."""
    s = f"(CASE WHEN length({x}) <= length({y}) THEN {x} ELSE {y} END)"
    t = f"(CASE WHEN length({x}) <= length({y}) THEN {y} ELSE {x} END)"
    at = f"list_sum(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN {s}[i] = c THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END))"
    full = f"((CAST(1 AS HUGEINT) << CAST(length({s}) AS INTEGER)) - 1)"
    masks = f"list_transform(string_split({t}, ''), lambda c: CAST({at} AS HUGEINT))"
    step = f"((v + (v & m)) | (v - (v & m))) & {full}"
    return f"(CASE WHEN length({s}) = 0 THEN 0 ELSE length({s}) - bit_count(list_reduce({masks}, lambda v, m: {step}, {full})) END)"


_BITS = 120
_FULL = f"((CAST(1 AS HUGEINT) << {_BITS}) - 1)"


def _long_lcs(src: str, name: str, columns: dict[str, tuple[str, str]]) -> dict[str, str]:
    """Table ``name``: ``src`` with the length of the longest common subsequence of pairs of columns of any length, {new column: (a, b)}.

    The shorter text is cut into blocks of 120 characters, each the bits of an integer; a step for a character of the longer
    one goes through the blocks and carries from one to the next. What is left unset at the end is the length.
    """
    out, made = {}, []
    for k, (x, y) in columns.items():
        pairs, letters, state = f"{name}_{k}_p", f"{name}_{k}_m", f"{name}_{k}"
        out[pairs] = f"""SELECT DISTINCT {x} AS a, {y} AS b, CASE WHEN length({x}) <= length({y}) THEN string_split({x}, '') ELSE string_split({y}, '') END AS s,
          CASE WHEN length({x}) <= length({y}) THEN string_split({y}, '') ELSE string_split({x}, '') END AS t FROM {src} WHERE length({x}) > 0 AND length({y}) > 0"""
        block = f"list_sum(list_transform(range(1, 1 + least({_BITS}, len(s) - {_BITS} * k)), lambda i: CASE WHEN s[{_BITS} * k + i] = c THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END))"
        out[letters] = f"""SELECT a, b, s, t, CAST((len(s) + {_BITS - 1}) // {_BITS} AS INTEGER) AS n,
          map_from_entries(list_transform(list_distinct(t), lambda c: struct_pack(k := c, v := list_transform(range((len(s) + {_BITS - 1}) // {_BITS}), lambda k: CAST({block} AS HUGEINT))))) AS masks FROM {pairs}"""
        sum_ = "(v[j] + (v[j] & masks[c][j]) + acc.carry)"
        inner = f"""list_reduce(range(1, n + 1), lambda acc, j: struct_pack(carry := CAST({sum_} >> {_BITS} AS HUGEINT), l := list_append(acc.l, CAST(({sum_} & {_FULL}) | (v[j] - (v[j] & masks[c][j])) AS HUGEINT))),
          struct_pack(carry := CAST(0 AS HUGEINT), l := CAST([] AS HUGEINT[]))).l"""
        out[state] = f"""SELECT a, b, CAST({_BITS} * n - list_sum(list_transform(list_reduce(t, lambda v, c: {inner}, list_transform(range(n), lambda k: {_FULL})), lambda z: bit_count(z))) AS BIGINT) AS len FROM {letters}"""
        made.append((k, state, x, y))
    joins = " ".join(f"LEFT JOIN {t} q_{k} ON q_{k}.a = r.{x} AND q_{k}.b = r.{y}" for k, t, x, y in made)
    out[name] = f"SELECT r.*, {', '.join(f'coalesce(q_{k}.len, 0) AS {k}' for k, *_ in made)} FROM {src} r {joins}"
    return out


def _ratio(x: str, y: str) -> str:
    return f"(CASE WHEN length({x}) + length({y}) = 0 THEN 100.0 ELSE CAST(200.0 AS DOUBLE) * {_lcs(x, y)} / (length({x}) + length({y})) END)"


def _sorted(words: str) -> str:
    return f"array_to_string(list_sort({words}), ' ')"


CTES: dict[str, str] = {
    "doc": "SELECT *, 'S' || CAST(1 + doc_id % 3 AS VARCHAR) || '-' || CAST(doc_id AS VARCHAR) AS entity_id FROM documents WHERE doc_id IS NOT NULL",
    "ent": f"""SELECT entity_id, lang AS country, array_to_string(w[1:5], ' ') AS business_name,
      concat_ws(' ', CAST(n_chars % 100 AS VARCHAR), array_to_string(w[6:], ' '), CAST(10000 + n_chars % 50 AS VARCHAR)) AS business_address
      FROM (SELECT entity_id, lang, n_chars, {_pieces("lower(coalesce(text, ''))")} AS w FROM doc)""",
    "rec": f"SELECT entity_id, country, {_name('business_name')} AS name, {_address('business_address')} AS address FROM ent",
    "s1": "SELECT * FROM rec WHERE entity_id LIKE 'S1-%'",
    "tg": "SELECT * FROM rec WHERE entity_id NOT LIKE 'S1-%'",
    "truth": "SELECT a.entity_id AS s1_id, b.entity_id AS t_id FROM doc a JOIN doc b ON a.text = b.text AND a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'",
    "post": f"SELECT country, entity_id, unnest(list_distinct(list_filter({_pieces('''lower(name || ' ' || address)''')}, lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}|[0-9]{{2}}')))) AS token FROM rec",
    "tpost": "SELECT country, token, entity_id FROM post WHERE entity_id NOT LIKE 'S1-%'",
    "df": "SELECT country, token, count(*) AS df FROM tpost GROUP BY ALL",
    "rare": f"SELECT p.country, p.token, p.entity_id FROM tpost p JOIN df USING (country, token) WHERE df < {PARAMS.max_df}",
    "overlap": "SELECT a.entity_id AS s1_id, b.entity_id AS t_id, count(*) AS overlap FROM post a JOIN rare b USING (country, token) WHERE a.entity_id LIKE 'S1-%' GROUP BY ALL",
    "topk": f"SELECT s1_id, t_id, overlap, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY overlap DESC, t_id) AS rank FROM overlap) WHERE rank <= {PARAMS.pool}",
    "sq": f"SELECT country, entity_id, {_squash('name', True)} AS squash FROM rec",
    "squashed": f"SELECT a.entity_id AS s1_id, b.entity_id AS t_id, squash FROM sq a JOIN sq b USING (country, squash) WHERE length(squash) >= {PARAMS.squash_length} AND a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'",
    "pool": "SELECT s1_id, t_id FROM topk UNION SELECT s1_id, t_id FROM squashed",
    "prep": f"""SELECT entity_id, name, address, {_squash('name', True)} AS squash, {_words('name')} AS nw, list_distinct({_words('name')}) AS ns, list_distinct({_words('address')}) AS aw,
      {_numbers('address', 5, 6)}[1] AS postal, {_numbers('address', 1)}[1] AS number, list_distinct({_numbers('address', 2, 6)}) AS numbers, list_distinct({_numbers('address', 5, 6)}) AS postals FROM rec""",
}


def _pair_table(pairs: str) -> str:
    """Pairs with both sides' fields and, for words of names and addresses as sets, shared words and both rests."""
    rest = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda w: NOT list_contains({y}, w))), ' ')"
    both = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda w: list_contains({y}, w))), ' ')"
    return f"""SELECT p.*, a.name AS an, b.name AS bn, a.address AS aa, b.address AS ba, a.squash AS asq, b.squash AS bsq, a.postal AS ap, b.postal AS bp, a.number AS anum, b.number AS bnum,
      a.nw AS anw, b.nw AS bnw, a.ns AS ans, b.ns AS bns, a.aw AS aaw, b.aw AS baw, a.numbers AS anums, b.numbers AS bnums, a.postals AS apost, b.postals AS bpost,
      {both('a.ns', 'b.ns')} AS n_both, {rest('a.ns', 'b.ns')} AS n_left, {rest('b.ns', 'a.ns')} AS n_right,
      {both('a.aw', 'b.aw')} AS a_both, {rest('a.aw', 'b.aw')} AS a_left, {rest('b.aw', 'a.aw')} AS a_right
      FROM {pairs} p JOIN prep a ON a.entity_id = p.s1_id JOIN prep b ON b.entity_id = p.t_id"""


def _token_set(k: str, x: str, y: str, common: str = "") -> str:
    """``common`` is a column that has the subsequence of both rests already."""
    b, left, right = f"{k}_both", f"{k}_left", f"{k}_right"
    head = f"(CASE WHEN length({b}) > 0 THEN length({b}) + 1 ELSE 0 END)"
    main = f"CAST(200.0 AS DOUBLE) * ({head} + {common or _lcs(left, right)}) / (2 * {head} + length({left}) + length({right}))"
    beside = lambda r: f"CAST(200.0 AS DOUBLE) * length({b}) / (2 * length({b}) + 1 + length({r}))"
    return f"""(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 WHEN length({b}) > 0 AND (length({left}) = 0 OR length({right}) = 0) THEN 100.0
      WHEN length({b}) > 0 THEN greatest({main}, {beside(left)}, {beside(right)}) ELSE {main} END)"""


_GUARD = f"ap IS NOT NULL AND bp IS NOT NULL AND ap <> bp AND name_set < {PARAMS.guard}"
_MIXED = f"greatest(name_score * 0.70 + addr_score * 0.30, CASE WHEN addr_score >= {PARAMS.strong_address} THEN addr_score ELSE 0.0 END, sq_score)"

CTES |= {
    "pairtab": _pair_table("pool"),
    "namesets": f"SELECT *, {_token_set('n', 'ans', 'bns')} AS name_set FROM pairtab",
    "guarded": f"SELECT * FROM namesets WHERE NOT coalesce({_GUARD}, false)",
    "near": f"SELECT *, asq <> '' AND bsq <> '' AND abs(length(asq) - length(bsq)) <= {PARAMS.squash_gap} AS is_near FROM guarded",
    **_long_lcs("near", "near_a", {"a_len": ("a_left", "a_right")}),
    "scored0": f"""SELECT *, CASE WHEN is_near THEN {_ratio('asq', 'bsq')} ELSE 0.0 END AS sq_score,
      CASE WHEN aa <> '' AND ba <> '' THEN least(100.0, {_token_set('a', 'aaw', 'baw', 'a_len')} + CASE WHEN anum = bnum THEN 10.0 ELSE 0.0 END) ELSE 0.0 END AS addr_score FROM near_a""",
    "scored1": "SELECT *, greatest(name_set, sq_score) AS name_score FROM scored0",
    "scored": f"SELECT *, CASE WHEN aa <> '' AND ba <> '' THEN {_MIXED} ELSE name_score * 0.85 END AS score FROM scored1",
    "cand": f"""SELECT * FROM (SELECT *, {_source('t_id')} AS source, CAST(row_number() OVER (PARTITION BY s1_id, {_source('t_id')} ORDER BY score DESC, t_id) AS INTEGER) AS rank
      FROM scored WHERE score >= {PARAMS.min_score} OR addr_score >= {PARAMS.strong_address}) WHERE rank <= {PARAMS.per_source}""",
    "judged": "SELECT *, round(score / 100.0, 6) AS p FROM cand",
    "matched": f"SELECT * FROM judged WHERE CASE WHEN ba = '' AND aa <> '' THEN p >= 0.90 AND name_set >= 85 ELSE p >= {THRESHOLD} END",
    "combined": f"SELECT *, round(CASE WHEN aa <> '' AND ba <> '' THEN name_set * 0.70 + {_token_set('a', 'aaw', 'baw', 'a_len')} * 0.30 ELSE name_set * 0.85 END, 6) AS together FROM matched",
    "excl": "SELECT s1_id, t_id, score, together, CAST(row_number() OVER (PARTITION BY t_id ORDER BY together DESC, s1_id) AS INTEGER) AS won FROM combined",
    "final": "SELECT * FROM excl WHERE won = 1",
    "outc": "SELECT s1_id, t_id, max(f) AS f, max(t) AS t FROM (SELECT DISTINCT s1_id, t_id, 1 AS f, 0 AS t FROM final UNION ALL SELECT DISTINCT s1_id, t_id, 0, 1 FROM truth) GROUP BY ALL",
    "topn": _pair_table("topk"),
    "labels1": "SELECT j.p, CASE WHEN t.t_id IS NULL THEN 0 ELSE 1 END AS label FROM judged j LEFT JOIN (SELECT DISTINCT * FROM truth) t USING (s1_id, t_id)",
    "sweep": """SELECT CAST(k AS DOUBLE) / 100.0 AS threshold, CAST(coalesce(sum(label) FILTER (WHERE p + 1e-11 >= k / 100.0), 0) AS BIGINT) AS tp, count(*) FILTER (WHERE p + 1e-11 >= k / 100.0) AS n_found, CAST(sum(label) AS BIGINT) AS n_true
      FROM labels1, range(50, 95) r(k) GROUP BY k""",
    "sweep2": "SELECT *, CASE WHEN n_found > 0 THEN tp / n_found ELSE 0.0 END AS precision, CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS recall FROM sweep",
    "sweep3": "SELECT *, CASE WHEN 0.25 * precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0.0 END AS f_beta FROM sweep2",
    "ngw": f"SELECT entity_id, country, unnest(list_transform({_words('''name || ' ' || address''')}, lambda w: ' ' || w || ' ')) AS w FROM rec",
    "gram34": "SELECT entity_id, country, unnest(flatten(list_transform([3, 4], lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))))) AS gram FROM ngw",
    "gram35": "SELECT entity_id, country, unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))))) AS gram FROM ngw",
    "tf34": "SELECT entity_id, country, gram, CAST(count(*) AS DOUBLE) AS w FROM gram34 GROUP BY ALL",
    "tf35": "SELECT entity_id, country, gram, count(*) AS tf FROM gram35 GROUP BY ALL",
    "df35": "SELECT country, gram, count(*) AS df FROM tf35 GROUP BY ALL HAVING count(*) >= 3",
    "nrec": "SELECT country, count(*) AS n FROM rec GROUP BY country",
    "w35": "SELECT entity_id, country, gram, (1 + ln(tf)) * (ln(CAST(1 + n AS DOUBLE) / (1 + df)) + 1) AS w FROM tf35 JOIN df35 USING (country, gram) JOIN nrec USING (country)",
    "u34": "SELECT t.entity_id, country, gram, w / nm AS w FROM tf34 t JOIN (SELECT entity_id, sqrt(sum(w * w)) AS nm FROM tf34 GROUP BY entity_id) USING (entity_id)",
    "u35": "SELECT t.entity_id, country, gram, w / nm AS w FROM w35 t JOIN (SELECT entity_id, sqrt(sum(w * w)) AS nm FROM w35 GROUP BY entity_id) USING (entity_id)",
}


def _cosine_cte(u: str, k: int, least: float, by: str) -> str:
    return f"""SELECT s1_id, t_id, sim, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY s1_id{by} ORDER BY sim DESC, t_id) AS rank FROM (
        SELECT a.entity_id AS s1_id, b.entity_id AS t_id, {_source('b.entity_id')} AS source, round(sum(a.w * b.w), 9) AS sim FROM {u} a JOIN {u} b USING (country, gram)
        WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%' GROUP BY ALL) WHERE sim >= {least}) WHERE rank <= {k}"""


CTES |= {"cos34": _cosine_cte("u34", 15, 0.08, ", source"), "cos35": _cosine_cte("u35", 25, 0.0, "")}

_FAULTS = """CASE doc_id % 8 WHEN 0 THEN 'S2-1,S2-1' WHEN 1 THEN 'S1-5' WHEN 2 THEN 'X-1' WHEN 3 THEN 'S2-4,' WHEN 4 THEN ''
  WHEN 5 THEN 'S3-99999999' WHEN 6 THEN 'S2-1' ELSE 'S2-' || CAST(1 + doc_id - doc_id % 3 AS VARCHAR) END"""
CTES |= {
    "vrows": f"SELECT entity_id AS id, doc_id, {_FAULTS} AS list, entity_id || CASE WHEN doc_id % 8 = 6 THEN ' ' ELSE chr(9) END || {_FAULTS} AS line FROM doc",
    "vfile": "SELECT id, doc_id, list, line FROM vrows UNION ALL SELECT id, doc_id, list, line FROM vrows WHERE doc_id % 50 = 0",
    "vids": "SELECT id, CASE WHEN list = '' THEN [] ELSE string_split(list, ',') END AS ids FROM vfile",
    "vone": "SELECT id, unnest(ids) AS t FROM vids",
    "vcand": "SELECT id, unnest(string_split(CASE WHEN doc_id % 16 = 7 THEN '' ELSE list END, ',')) AS t FROM vrows",
    "vwant": "SELECT entity_id AS id FROM s1",
    "vfound": """
      SELECT 'no_tab' AS rule, 'error' AS severity, line AS x FROM vfile WHERE line NOT LIKE '%' || chr(9) || '%'
      UNION ALL SELECT 'duplicate_row', 'error', id FROM (SELECT id FROM vids GROUP BY id HAVING count(*) > 1)
      UNION ALL SELECT 'duplicate_in_list', 'error', id FROM vids WHERE len(ids) <> len(list_distinct(ids))
      UNION ALL SELECT 'reference_in_list', 'error', t FROM vone WHERE t LIKE 'S1-%'
      UNION ALL SELECT 'bad_prefix', 'error', id FROM vone WHERE t NOT LIKE 'S1-%' AND t NOT LIKE 'S2-%' AND t NOT LIKE 'S3-%'
      UNION ALL SELECT 'unknown_id', 'error', t FROM vone WHERE (t LIKE 'S2-%' OR t LIKE 'S3-%') AND t NOT IN (SELECT entity_id FROM tg)
      UNION ALL SELECT 'missing_record', 'error', id FROM vwant WHERE id NOT IN (SELECT id FROM vids)
      UNION ALL SELECT 'extra_record', 'error', id FROM (SELECT DISTINCT id FROM vids) WHERE id NOT IN (SELECT id FROM vwant)
      UNION ALL SELECT 'not_a_candidate', 'warning', id || ':' || t FROM (SELECT DISTINCT id, t FROM vone WHERE t <> '' EXCEPT SELECT id, t FROM vcand)""",
    "vrules": """SELECT * FROM (VALUES ('no_tab', 'error'), ('duplicate_row', 'error'), ('duplicate_in_list', 'error'), ('reference_in_list', 'error'), ('bad_prefix', 'error'),
      ('unknown_id', 'error'), ('missing_record', 'error'), ('extra_record', 'error'), ('not_a_candidate', 'warning')) v(rule, severity)""",
}


def _r(names) -> str:
    return ", ".join(f"round({n}, 4) AS {n}" for n in names)


def _hash_bucket(x: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % {n})"


def _windows(src: str, name: str) -> dict[str, str]:
    """Partial ratio of an and bn of ``src``: one row per window of the longer, the best of them; both ways if they are as long as each other."""
    return {
        f"{name}_d": f"SELECT DISTINCT an, bn FROM {src}",
        f"{name}_o": f"SELECT an, bn, CASE WHEN length(an) <= length(bn) THEN an ELSE bn END AS s, CASE WHEN length(an) <= length(bn) THEN bn ELSE an END AS l FROM {name}_d UNION ALL SELECT an, bn, bn, an FROM {name}_d WHERE length(an) = length(bn)",
        f"{name}_w": f"SELECT an, bn, s, unnest(list_transform(range(1, length(l) + length(s)), lambda e: substr(l, greatest(1, e - length(s) + 1), least(e, length(s), length(s) + length(l) - e)))) AS w FROM {name}_o WHERE length(s) > 0",
        f"{name}_b": f"SELECT an, bn, max({_ratio('s', 'w')}) AS best FROM {name}_w GROUP BY ALL",
        name: f"SELECT t.*, CASE WHEN t.an = '' AND t.bn = '' THEN 100.0 ELSE coalesce(b.best, 0.0) END AS partial FROM {src} t LEFT JOIN {name}_b b ON b.an = t.an AND b.bn = t.bn",
    }


CTES |= _windows("topn", "topw")
CTES |= {"tops": f"SELECT *, {_sorted('anw')} AS asort, {_sorted('bnw')} AS bsort FROM topn"}

_STATES = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in US_STATES.items()) + "}"

FINAL: dict[str, str] = {
    "validate_counts": "SELECT count(*) AS n_rows, count(*) FILTER (WHERE trim(list) <> '') AS filled, count(*) FILTER (WHERE trim(list) = '') AS empty FROM vfile",
    "exclusivity_summary": "SELECT count(*) AS claims, count(*) FILTER (WHERE won = 1) AS kept, count(*) FILTER (WHERE won > 1) AS eliminated, count(*) FILTER (WHERE won = 2) AS contested FROM excl",
    "expand_states": f"SELECT entity_id, array_to_string(list_transform({_words('address')}, lambda w: coalesce({_STATES}[w], w)), ' ') AS address FROM rec",
    "normalize_name": f"SELECT entity_id, {_name('business_name')} AS name FROM ent",
    "normalize_address": f"SELECT entity_id, {_address('business_address')} AS address FROM ent",
    "name_tokens": f"SELECT entity_id, array_to_string(list_filter({_words('name')}, lambda w: length(w) > 1), ' ') AS name_tokens FROM rec",
    "text_concat": "SELECT entity_id, name || ' ' || address AS whole FROM rec",
    "blocking_tokens": "SELECT country, token, entity_id FROM post",
    "squash_strong": f"SELECT entity_id, {_squash('name', True)} AS squash FROM rec",
    "squash_weak": f"SELECT entity_id, {_squash('name', False)} AS squash FROM rec",
    "postal_numbers": "SELECT entity_id, postal, number, array_to_string(list_sort(numbers), ',') AS numbers, array_to_string(list_sort(postals), ',') AS postals FROM prep",
    "source_partitions": f"SELECT 'test' AS split, {_source('entity_id')} AS source, country, count(*) AS records FROM rec GROUP BY ALL",
    "token_df": "SELECT country, token, df FROM df",
    "stop_token_prune": "SELECT country, token, entity_id FROM rare",
    "overlap_join": "SELECT s1_id, t_id, overlap FROM overlap",
    "overlap_topk": "SELECT * FROM topk",
    "squash_join": "SELECT s1_id, t_id, squash FROM squashed",
    "candidate_pool": "SELECT s1_id, t_id FROM pool",
    "postal_guard": "SELECT s1_id, t_id FROM guarded",
    "dual_channel_score": f"SELECT s1_id, t_id, {_r(['sq_score', 'name_score', 'addr_score', 'score'])} FROM scored",
    "candidate_pairs": "SELECT s1_id, t_id, source, round(score, 4) AS score, rank FROM cand",
    "candidate_list": "SELECT entity_id AS s1_id, coalesce((SELECT string_agg(t_id, ',' ORDER BY source, rank) FROM cand WHERE s1_id = entity_id), '') AS candidates FROM s1",
    "indel_ratio": f"SELECT s1_id, t_id, round({_ratio('an', 'bn')}, 4) AS ratio FROM topn",
    "token_sort_ratio": f"SELECT s1_id, t_id, round({_ratio('asort', 'bsort')}, 4) AS ratio FROM tops",
    "token_set_ratio": f"SELECT s1_id, t_id, round({_token_set('n', 'ans', 'bns')}, 4) AS ratio FROM topn",
    "partial_ratio": "SELECT s1_id, t_id, round(partial, 4) AS ratio FROM topw",
    "ngram_cosine_topk": "SELECT s1_id, t_id, sim, rank FROM cos34",
    "hashed_ngrams": f"""SELECT entity_id, count(*) AS places, count(*) FILTER (WHERE n > 0) AS positive, round(sum(abs(n)) / sqrt(sum(n * n)), 6) AS total, CAST(sum(place * sign(n)) AS BIGINT) AS placed FROM (
      SELECT entity_id, {_hash_bucket('gram', 65536)} AS place, CAST(sum(CASE WHEN CAST('0x' || substr(md5(gram), 9, 8) AS BIGINT) % 2 = 0 THEN w ELSE -w END) AS DOUBLE) AS n FROM tf34 GROUP BY ALL)
      WHERE n <> 0 GROUP BY entity_id""",
    "tfidf_cosine_topk": "SELECT s1_id, t_id, sim, rank FROM cos35",
    "positive_pairs": "SELECT s1_id, t_id FROM truth WHERE t_id IN (SELECT entity_id FROM tg)",
    "target_sample": f"SELECT entity_id, {_source('entity_id')} AS source, entity_id IN (SELECT t_id FROM truth) AS needed FROM tg WHERE entity_id IN (SELECT t_id FROM truth) OR {_hash_bucket('entity_id', 4)} < 1",
    "hard_negatives": "SELECT * FROM (SELECT s1_id, t_id, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY rank) AS INTEGER) AS rn FROM topk ANTI JOIN truth USING (s1_id, t_id)) WHERE rn <= 4",
    "entity_split": f"SELECT s1_id, t_id, {_hash_bucket('s1_id', 5)} = 0 AS held_out FROM topk",
    "threshold_sweep": f"SELECT threshold, tp, n_found, n_true, {_r(['precision', 'recall', 'f_beta'])} FROM sweep3",
    "best_threshold": "SELECT threshold, round(f_beta, 4) AS f_beta FROM sweep3 ORDER BY sweep3.f_beta DESC, threshold LIMIT 1",
    "decision_rule": "SELECT s1_id, t_id, round(p, 4) AS p FROM matched",
    "collision_targets": "SELECT t_id, count(*) AS claims FROM matched GROUP BY t_id HAVING count(*) > 1",
    "exclusive_assignment": "SELECT s1_id, t_id, round(together, 4) AS combined, won AS rank FROM excl",
    "match_list": "SELECT entity_id AS s1_id, coalesce((SELECT string_agg(t_id, ',' ORDER BY substr(t_id, 1, 2), score DESC, t_id) FROM final WHERE s1_id = entity_id), '') AS matched FROM s1",
    "pairwise_metrics": """SELECT tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN 0.25 * p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0.0 END, 4) AS f_beta FROM (
      SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM (
        SELECT CAST(coalesce(sum(f * t), 0) AS BIGINT) AS tp, CAST(coalesce(sum(f * (1 - t)), 0) AS BIGINT) AS fp, CAST(coalesce(sum((1 - f) * t), 0) AS BIGINT) AS fn FROM outc))""",
    "macro_fbeta": """SELECT count(*) AS records, round(avg(CASE WHEN n_true = 0 AND n_found = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_found) * (tp / n_true) / (0.25 * (tp / n_found) + tp / n_true) END), 4) AS macro_f_beta FROM (
      SELECT entity_id, coalesce(sum(f * t), 0) AS tp, coalesce(sum(f), 0) AS n_found, coalesce(sum(t), 0) AS n_true FROM s1 LEFT JOIN outc ON s1_id = entity_id GROUP BY entity_id)""",
    "blocking_recall": "SELECT count(*) AS true_pairs, count(k.t_id) AS found_pairs, round(count(k.t_id) / count(*), 4) AS recall FROM (SELECT DISTINCT * FROM truth) LEFT JOIN topk k USING (s1_id, t_id)",
    "cosine_recall": "SELECT count(*) AS true_pairs, count(k.t_id) AS found_pairs, round(count(k.t_id) / count(*), 4) AS recall FROM (SELECT DISTINCT * FROM truth) LEFT JOIN cos35 k USING (s1_id, t_id)",
    "reduction_ratio": "SELECT p AS pairs, a AS n_records, b AS n_targets, round(1.0 - CAST(p AS DOUBLE) / (a * b), 6) AS ratio FROM (SELECT (SELECT count(*) FROM topk) AS p, (SELECT count(*) FROM s1) AS a, (SELECT count(*) FROM tg) AS b)",
    "country_rollup": """SELECT CASE WHEN grouping(country) = 1 THEN 'ALL' ELSE country END AS country, count(*) AS records, CAST(sum(hit) AS BIGINT) AS matched, CAST(count(*) - sum(hit) AS BIGINT) AS singletons,
      round(100.0 * CAST(count(*) - sum(hit) AS DOUBLE) / count(*), 4) AS singleton_share
      FROM (SELECT country, CASE WHEN entity_id IN (SELECT s1_id FROM topk) THEN 1 ELSE 0 END AS hit FROM s1) GROUP BY ROLLUP (country)""",
    "validate_report": """SELECT r.rule, r.severity, count(f.x) AS n, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT x FROM vfound v WHERE v.rule = r.rule ORDER BY x LIMIT 5)), '') AS examples
      FROM vrules r LEFT JOIN vfound f ON f.rule = r.rule GROUP BY r.rule, r.severity""",
    "entity_search": """SELECT entity_id, country, name, address, n AS match_count FROM s1 JOIN (SELECT s1_id, count(*) AS n FROM topk GROUP BY s1_id) ON s1_id = entity_id
      WHERE upper(country) = 'EN' AND contains(lower(entity_id || ' ' || name || ' ' || address), 'an') ORDER BY entity_id LIMIT 50""",
    "match_hydration": f"""SELECT s1_id, x.t_id, coalesce(tg.name, 'Entity ' || x.t_id) AS name, coalesce(tg.address, '') AS address, {_source('x.t_id')} AS source
      FROM (SELECT s1_id, CASE WHEN rank = {PARAMS.pool} THEN t_id || 'x' ELSE t_id END AS t_id FROM topk) x LEFT JOIN tg ON tg.entity_id = x.t_id""",
    "confidence_label": f"SELECT s1_id, t_id, CASE WHEN p >= 0.90 THEN 'High Confidence Match' WHEN p >= {THRESHOLD} THEN 'Match' WHEN p >= 0.50 THEN 'Borderline Non-Match' ELSE 'Distinct Businesses' END AS label FROM judged",
}

FINAL["batch_run"] = f"SELECT 'candidates' AS kind, s1_id, candidates AS ids FROM ({FINAL['candidate_list']}) UNION ALL SELECT 'matches', s1_id, matched FROM ({FINAL['match_list']})"


def _needed(sql: str) -> list[str]:
    """Names of the table expressions that a statement uses, each after those that it uses itself."""
    order: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for name in CTES:
            if name != own and name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name], name)
                order.append(name)

    visit(sql, None)
    return order


def oracle_sql() -> dict[str, str]:
    out = {}
    for query, sql in FINAL.items():
        parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in _needed(sql))
        # decimal literals would make DECIMAL columns where the queries have doubles
        out[query] = re.sub(r"(?<![\w.{])(\d+\.\d+)(?![\w.}])", r"\1e0", f"WITH {parts}\n{sql}")
    return out

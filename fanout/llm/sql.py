"""DuckDB SQL for the queries that SQL can express, over the given tables."""

from __future__ import annotations

from fanout.llm.shared import UPPER

_SPACE = r"[\x20\x09-\x0D]+"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def exact_groups(table: str = "documents") -> str:
    return f"""
    WITH t AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM {table})
    SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
    FROM t"""


def shingle_groups(width: int, num: int, den: int, table: str = "documents") -> str:
    """CTEs ending in ``grouped`` (doc_id, n_shingles, component_id)."""
    return f"""
    w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '{_SPACE}'), lambda x: x <> '') AS w FROM {table}),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS sh FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
               GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE {den} * c >= {num} * (x.n + y.n - c)),
    reach AS (SELECT doc_id, doc_id AS other FROM {table} UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other),
    grouped AS (SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id
                FROM w JOIN reach ON reach.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id)"""


def jaccard_groups(width: int, num: int, den: int) -> str:
    return f"WITH RECURSIVE {shingle_groups(width, num, den)} SELECT doc_id, n_shingles, component_id FROM grouped"


def quality_rules() -> str:
    """Counts of the base and of the line rules, word by word and line by line."""
    from fanout.llm.quality_rules import ENDS, MARKS, PHRASES, SEPARATORS, SYMBOLS, Rules

    rules = Rules()

    def literal(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    separators = ", ".join(map(literal, SEPARATORS))
    phrases = " OR ".join(f"contains(low, {literal(p)})" for p in PHRASES)
    split = f"list_filter(regexp_split_to_array({{}}, '{_SPACE}'), lambda x: x <> '')"
    n = rules.window
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, {split.format("text")} AS w FROM d),
    windows AS (SELECT r, i, list_aggregate(w[i:i + {n - 1}], 'string_agg', ' ') AS k
                FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w)),
    again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {n})) AS p FROM again) GROUP BY r),
    l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
    lw AS (SELECT r, line, translate(line, '{UPPER}', '{UPPER.lower()}') AS low, {split.format("line")} AS w FROM l),
    judged AS (SELECT r, line, CASE
        WHEN len(list_filter(w, lambda x: x IN ({separators}))) >= {rules.separators}
             AND 100 * len(list_filter(w, lambda x: x IN ({separators}))) >= {rules.separated} * len(w) THEN 1
        WHEN len(w) <= {rules.boilerplate_words} AND ({phrases}) THEN 2
        WHEN len(list_filter(w, lambda x: regexp_matches(x, {literal(ENDS)}))) = 0
             OR 100 * len(list_filter(w, lambda x: regexp_matches(x, {literal(MARKS)}))) > {rules.marked} * len(w) THEN 3
        ELSE 0 END AS rule, length(regexp_replace(line, '{_SPACE}', '', 'g')) AS chars
        FROM lw WHERE len(w) > 0),
    lines AS (SELECT r, count(*) - count(DISTINCT line) AS doubled, count(*) FILTER (rule = 1) AS r1,
                     count(*) FILTER (rule = 2) AS r2, count(*) FILTER (rule = 3) AS r3,
                     sum(chars) FILTER (rule > 0) AS lost FROM judged GROUP BY r),
    m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
                 length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(doubled, 0) AS n_dup_lines,
                 coalesce(covered.n, 0) AS n_repeat_words, coalesce(r1, 0) AS n_navigation_lines,
                 coalesce(r2, 0) AS n_boilerplate_lines, coalesce(r3, 0) AS n_punctuation_lines,
                 coalesce(lost, 0)::BIGINT AS lost_chars
          FROM w LEFT JOIN covered USING (r) LEFT JOIN lines USING (r))
    SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeated} * n_words AS base_failed,
           NOT (base_failed OR 100 * lost_chars > {rules.lost} * word_chars) AS kept FROM m"""


def merkle_manifest(fanout: int = 3) -> str:
    """The trees level by level, then every row's fold from its leaf to the root."""

    def leaf(text: str) -> str:
        columns = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"

    def levels(name: str, start: str) -> str:
        return f"""
    {name} AS (SELECT * FROM ({start})
      UNION ALL SELECT level + 1, tree, place // {fanout}, (nodes + {fanout - 1}) // {fanout}, sha256(string_agg(h, '' ORDER BY place))
      FROM {name} WHERE nodes > 1 GROUP BY level, tree, nodes, place // {fanout}),
    {name}_runs AS (SELECT level, tree, place // {fanout} AS run, list(h ORDER BY place) AS hs FROM {name} WHERE nodes > 1 GROUP BY ALL)"""

    def fold(name: str, start: str) -> str:
        slot = f"(place % {fanout})"
        before = f"array_to_string(hs[1:{slot}], '')"
        after = f"array_to_string(hs[{slot} + 2:], '')"
        return f"""
    {name}_fold AS (SELECT * FROM ({start})
      UNION ALL SELECT f.id, f.level + 1, f.tree, place // {fanout}, sibs || {before} || {after}, sha256({before} || h || {after})
      FROM {name}_fold f JOIN {name}_runs r ON r.level = f.level AND r.tree = f.tree AND r.run = place // {fanout}),
    {name}_top AS (SELECT id, max_by(sibs, level) AS sibs, max_by(h, level) AS h FROM {name}_fold GROUP BY id)"""

    return f"""
    WITH RECURSIVE raw AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {leaf("text")} AS leaf,
        {leaf("replace(text, chr(10), '')")} AS torn FROM documents),
    d AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                 count(*) OVER (PARTITION BY tree) AS nodes FROM raw),
    c AS (SELECT doc_id, bits FROM (SELECT DISTINCT doc_id FROM d WHERE doc_id IS NOT NULL), LATERAL (
          SELECT list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1)))),
          lambda crc, b: list_reduce(list_prepend(xor(crc, b::BIGINT), range(8)), lambda x, k: CASE WHEN x % 2 = 1
          THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS bits)),
    {levels("sub", "SELECT 0 AS level, tree, place, nodes, leaf AS h FROM d")},
    s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS nodes
          FROM sub WHERE nodes = 1),
    {levels("top", "SELECT 0 AS level, 'all' AS tree, place, nodes, subroot AS h FROM s")},
    {fold("sub", "SELECT id, 0 AS level, tree, place, '' AS sibs, CASE WHEN bits % 2 = 1 THEN torn ELSE leaf END AS h FROM d LEFT JOIN c USING (doc_id)")},
    t AS (SELECT d.id, d.doc_id, leaf, subroot, s.place, sibs, h FROM d JOIN s USING (tree) JOIN sub_top USING (id)),
    {fold("top", "SELECT id, 0 AS level, 'all' AS tree, place, sibs, h FROM t")}
    SELECT doc_id, leaf, subroot, r.h AS root, sha256(f.sibs) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
    FROM t JOIN top_top f USING (id), (SELECT h FROM top WHERE nodes = 1) r"""


def conversation_repair() -> str:
    """Damage, faults, and a forward pass over each conversation's rows that keeps, for every state, the cheapest
    output so far and, of those, the least audit."""
    space = r"[\x20\x09-\x0D]"
    empty = "{'cost': 0::BIGINT, 'audit': '', 'out': ''}"

    def grown(cost: str, letter: str, line: str = "") -> str:
        out = f", 'out': b.out || {line} || chr(10)" if line else ", 'out': b.out"
        return f"{{'cost': b.cost + {cost}, 'audit': b.audit || '{letter}'{out}}}"

    spoken = "CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END"

    def put_in(source: str, name: str) -> str:
        turns = f"SELECT conv, i, {spoken}[1] AS state, {grown('3', 'I', f'({spoken}) || chr(58)')} AS b FROM"
        return f"""
        {name}_1 AS ({turns} {source}), {name}_2 AS ({turns} {name}_1),
        {name} AS (SELECT conv, i, state, min(b) AS b FROM (FROM {source} UNION ALL FROM {name}_1 UNION ALL FROM {name}_2) GROUP BY ALL)"""

    return f"""
    WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named FROM conversations),
    c AS (SELECT named, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(range(1, length(named) + 1), lambda i: ascii(substr(named, i, 1)))),
          lambda crc, b: list_reduce(list_prepend(xor(crc, b::BIGINT), range(8)), lambda x, k: CASE WHEN x % 2 = 1
          THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS harm FROM (SELECT DISTINCT named FROM raw)),
    h AS (SELECT coalesce('1' || conv_id, '0') AS conv, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
          CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
          unnest(CASE harm WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw JOIN c USING (named)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM h),
    f AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
          NOT blank AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS duplicate,
          NOT blank AND NOT duplicate AND NOT regexp_matches(text, '[.!?]{space}*$') AS truncated,
          lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1] AS pair FROM o),
    facts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
              count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
              count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
    dp AS (
      SELECT conv, -1::BIGINT AS i, '' AS state, {empty} AS b FROM facts
      UNION ALL
      (WITH start AS (SELECT conv, i, state, b FROM dp), {put_in('start', 'ready')},
       step AS (SELECT r.conv, r.i, r.role, r.text, state, b, blank OR duplicate AS gone, CASE WHEN truncated THEN 3 ELSE 0 END AS extra
                FROM ready JOIN f r ON r.conv = ready.conv AND r.i = ready.i + 1),
       done AS (
         SELECT conv, i, state, {grown('4', 'D')} AS b FROM step
         UNION ALL SELECT conv, i, role[1], {grown('extra', 'K', "role || ':' || text")} FROM step
           WHERE NOT gone AND (state || role[1] IN ('s', 'u', 'su', 'ua', 'au') AND role <> '' AND (state = '' OR length(state || role[1]) = 2))
         UNION ALL SELECT conv, i, ({spoken})[1], {grown('3 + extra', 'R', f"({spoken}) || ':' || text")} FROM step WHERE NOT gone)
       SELECT conv, i, state, min(b) AS b FROM done GROUP BY ALL)),
    start AS (SELECT conv, i, state, b FROM dp JOIN facts USING (conv) WHERE i = n - 1),
    {put_in('start', 'ready')},
    best AS (SELECT conv, min(b) AS b FROM ready WHERE state IN ('', 'a') GROUP BY conv)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost,
           coalesce(b.audit, '') AS audit, sha256(coalesce(CASE WHEN b.out = '' THEN '' ELSE b.out[:-2] END, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce('1' || conv_id, '0') AS conv FROM conversations)
    LEFT JOIN facts USING (conv) LEFT JOIN best USING (conv)"""

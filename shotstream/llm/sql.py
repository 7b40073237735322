"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from shotstream.llm import line_rules as rules
from shotstream.llm import sharding
from shotstream.llm.common import NOT_ALNUM, WORD_SPACE


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def line_rules(min_words: int = 50, max_loss: float = 0.5) -> str:
    space = _text(WORD_SPACE)
    bare = f"regexp_replace({{}}, {space}, '', 'g')"
    symbols = "(length({0}) - length(translate({0}, " + _text(rules.SYMBOLS) + ", '')))"
    fails = " OR ".join(
        [
            f"NOT regexp_matches(line, {_text(rules.TERMINAL)})",
            f"regexp_matches(line, {_text(rules.SEPARATED)})",
            f"length(line) <= 80 AND regexp_matches(line, {_text(rules.NAVIGATION)})",
            f"length(line) <= 200 AND regexp_matches(line, {_text(rules.BOILERPLATE)})",
            f"10 * {symbols.format('line')} > length(line)",
        ]
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS i
      FROM (SELECT r, list_filter(regexp_split_to_array(text, {space}), lambda x: x <> '') AS words FROM d)),
    g AS (SELECT r, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM w
      WINDOW p AS (PARTITION BY r ORDER BY i)),
    twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL)
      WHERE n > 1),
    repeated AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, range(3) AS t(o) GROUP BY 1),
    lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda line: length({bare.format('line')}) > 0) AS lines FROM d),
    good AS (SELECT r, lines, list_filter(lines, lambda line: NOT ({fails})) AS good FROM lines),
    m AS (SELECT d.r, doc_id, (SELECT count(*) FROM w WHERE w.r = d.r) AS n_words,
        length({bare.format('text')}) AS word_chars, {symbols.format('text')} AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
        len(lines) AS n_lines, len(lines) - len(good) AS n_bad_lines,
        length({bare.format("coalesce(array_to_string(lines, chr(10)), '')")})
          - length({bare.format("coalesce(array_to_string(good, chr(10)), '')")}) AS lost_chars,
        md5(coalesce(array_to_string(good, chr(10)), '')) AS clean_md5
      FROM d JOIN good USING (r) LEFT JOIN repeated USING (r))
    SELECT * EXCLUDE (r), n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      NOT (n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words)
        AND lost_chars <= {max_loss} * word_chars AS kept FROM m"""


def decontamination(similarity: float = 0.8, shingle: int = 5) -> str:
    """Every window that shares a shingle with an item, compared outright; a shorter text is one window."""
    words = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), {_text(NOT_ALNUM)}), lambda x: x <> '')"

    def cut(source: str, k: str) -> str:
        return f"list_transform(range(1, len(words) - {k} + 2), lambda i: array_to_string(words[i : i + {k} - 1], ' ')) AS {source}"

    return f"""
    WITH items AS (SELECT item_id, len(words) AS n, least({shingle}, len(words)) AS k, words
      FROM (SELECT item_id, {words} AS words FROM benchmark) WHERE len(words) > 0),
    item_shingles AS (SELECT item_id, n, k, n - k + 1 AS m, unnest({cut('s', 'k').removesuffix(' AS s')}) AS s FROM items),
    item_counts AS (SELECT item_id, n, k, m, s, count(*) AS c FROM item_shingles GROUP BY ALL),
    docs AS (SELECT doc_id, {words} AS words FROM documents),
    places AS (SELECT doc_id, k, unnest({cut('s', 'k').removesuffix(' AS s')}) AS s,
        unnest(range(0, len(words) - k + 1)) AS pos, len(words) - k + 1 AS size
      FROM docs, (SELECT DISTINCT k FROM items) WHERE len(words) >= k),
    starts AS (SELECT DISTINCT doc_id, item_id, n, k, m,
        least(m, size) AS span,
        unnest(range(greatest(0, pos - m + 1), greatest(0, least(pos, size - m)) + 1)) AS start
      FROM places JOIN item_counts USING (k, s)),
    windows AS (SELECT doc_id, item_id, n, m, span, start, s, count(*) AS c
      FROM starts JOIN places USING (doc_id, k) WHERE pos BETWEEN start AND start + m - 1 GROUP BY ALL),
    scored AS (SELECT doc_id, item_id, n, start, sum(least(w.c, i.c)) AS shared, any_value(w.m + span) AS together
      FROM windows w JOIN item_counts i USING (item_id, s, n) GROUP BY ALL)
    SELECT doc_id, item_id, round(max(shared / (together - shared)), 6) AS similarity,
      CAST(arg_min(start, (-shared, start)) AS INTEGER) AS start_word, CAST(any_value(n) AS INTEGER) AS n_words
    FROM scored WHERE shared / (together - shared) >= {similarity} - 1e-12 GROUP BY 1, 2"""


def shards() -> str:
    """The lookup in the filled table; filling it in turns is tested against a plain version."""
    owners = sharding.lookup_table().tolist()
    return f"""
    SELECT doc_id, slot, printf('shard-%03d', (SELECT {owners})[slot + 1]) AS shard
    FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
      % {sharding.SLOTS} AS slot FROM documents)"""


def line_dedup() -> str:
    """Keys held by two ids or more, and every line judged by them."""
    ends = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
    k AS (SELECT *, translate(trim(line, {ends}), '{upper}', '{upper.lower()}') AS key FROM l),
    held AS (SELECT key, min(coalesce(doc_id, {2**63 - 1})) AS owner FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT coalesce(doc_id, {2**63 - 1})) > 1),
    j AS (SELECT r, k.doc_id, i, line, held.key IS NOT NULL AND owner <> coalesce(k.doc_id, {2**63 - 1}) AS lost
      FROM k LEFT JOIN held USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
    FROM j GROUP BY r"""


def hard_negatives() -> str:
    """Every anchor against every row."""
    return """
    WITH e AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS row_id, a.label = e.label AS same,
        CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
      FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5),
    n AS (SELECT p.anchor_id, positive_id, positive_score, row_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, row_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
        AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM n WHERE rank <= 3"""


def filter_audit() -> str:
    """Every order walked step by step over the masks of the documents."""
    words = f"list_filter(regexp_split_to_array(text, {_text(WORD_SPACE)}), lambda x: x <> '')"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, {words} AS words, min(doc_id) OVER (PARTITION BY text) AS owner FROM d),
    j AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > owner, false)::INT AS mask
      FROM w LEFT JOIN j USING (doc_id)),
    cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
    prefixes AS (SELECT '' AS prefix, 0 AS applied, 0 AS bit UNION ALL
      SELECT prefix || letter, applied + p.bit, l.bit FROM prefixes p JOIN letters l ON (p.applied + p.bit) & l.bit = 0),
    steps AS (SELECT part, prefix,
        coalesce(sum(n) FILTER (mask & (applied + bit) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & applied <> 0 AND mask & bit <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS toxic_lost
      FROM cells, prefixes WHERE bit > 0 GROUP BY part, prefix),
    orders AS (SELECT prefix AS filter_order FROM prefixes WHERE length(prefix) = 5),
    r AS (SELECT part, filter_order, length(prefix) AS step, right(prefix, 1) AS letter, kept, removed, redundant,
        unique_fails, good_lost, toxic_lost
      FROM orders JOIN steps ON starts_with(filter_order, prefix))
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
      CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
      CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
      CAST(toxic_lost AS BIGINT) AS toxic_lost,
      CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
    FROM r"""

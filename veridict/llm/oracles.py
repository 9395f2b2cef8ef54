"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from veridict.llm import quality

LINE_DEDUP = r"""
WITH raw AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), line AS (
    SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM raw
), worded AS (
    SELECT doc_id, line_no, line,
           list_filter(regexp_split_to_array(line, '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS w
    FROM line
), numbered AS (
    SELECT doc_id, line_no, w, row_number() OVER (ORDER BY doc_id, line_no) AS place,
           array_to_string(w, ' ') AS t, len(w) AS n
    FROM worded WHERE len(w) > 0
), firsts AS (
    SELECT t, min(place) AS place FROM numbered GROUP BY t
), alive AS (
    SELECT n.* FROM numbered n JOIN firsts f ON n.place = f.place
), viewed AS (
    SELECT place, 'words' AS v, w AS u, t FROM alive WHERE n >= 8
    UNION ALL SELECT place, 'characters', string_split(t, ''), t FROM alive WHERE n <= 8 AND length(t) >= 8
), cut AS (
    SELECT place, v, i, CASE v WHEN 'words' THEN array_to_string(x, ' ') ELSE array_to_string(x, '') END AS c
    FROM (SELECT place, v, i, list_concat(u[1:i - 1], u[i + 1:]) AS x FROM (SELECT place, v, u, unnest(range(1, len(u) + 1)) AS i FROM viewed))
), replaced AS (
    SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY v, i, c) AS lo FROM cut) WHERE lo < place
), inserted AS (
    SELECT greatest(a.place, c.place) AS place FROM viewed a JOIN cut c ON a.v = c.v AND a.t = c.c WHERE a.place <> c.place
), gone AS (
    SELECT place FROM numbered WHERE place NOT IN (SELECT place FROM firsts)
    UNION SELECT place FROM replaced UNION SELECT place FROM inserted
), marked AS (
    SELECT l.doc_id, l.line_no, l.line, g.place IS NOT NULL AS gone
    FROM line l LEFT JOIN numbered n ON n.doc_id = l.doc_id AND n.line_no = l.line_no
    LEFT JOIN gone g ON g.place = n.place
), kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed,
           string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone) AS left_over
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN coalesce(k.n_removed, 0) = 0 THEN d.text ELSE coalesce(k.left_over, '') END AS text,
       coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NGRAM_JACCARD = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents
), gram AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                              ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
        FROM worded)
), size AS (
    SELECT doc_id, count(*) AS n FROM gram GROUP BY 1
), pair AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM gram a JOIN gram b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
    SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
    SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT reach.node, link.y FROM reach JOIN link ON reach.r = link.x
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach ON node = d.doc_id LEFT JOIN size USING (doc_id) GROUP BY d.doc_id
"""

SHARDING = """
WITH crc AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS i))
), coded AS (
    SELECT doc_id, coalesce(source, chr(0)) AS source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
           hex(encode(coalesce(text, ''))) AS h, source AS given FROM documents
), summed AS (
    SELECT c.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(size - 8), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
               lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM coded c, crc
), mixed AS (
    SELECT *, md5(concat_ws('|', '17', doc_id::VARCHAR, given, size::BIGINT::VARCHAR, text_crc32::BIGINT::VARCHAR)) AS mix FROM summed
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY mix, doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS total FROM mixed
), placed AS (
    SELECT *, row_number() OVER (ORDER BY (2 * r + 1) / (2.0::DOUBLE * total), source, mix, doc_id) - 1 AS pos, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * 24 // n)::INT AS shard,
       (pos - ((pos * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""

LM_SCORING = """
WITH bytes AS (
    SELECT doc_id, '00000000' || hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), gram AS (
    SELECT doc_id, substr(h, (2 * i + 1)::BIGINT, 10) AS g FROM (SELECT doc_id, h, unnest(range(n)) AS i FROM bytes)
), good AS (
    SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), own AS (
    SELECT doc_id, g, count(*)::DOUBLE AS c FROM gram GROUP BY 1, 2
), held AS (
    SELECT own.doc_id, g, c, (good.doc_id IS NOT NULL)::INT AS m, sum(c) OVER (PARTITION BY own.doc_id, substr(g, 1, 8)) AS ch,
           sum(c) OVER (PARTITION BY own.doc_id, substr(g, 9, 2)) AS cb, sum(c) OVER (PARTITION BY own.doc_id) AS ca
    FROM own LEFT JOIN good ON good.doc_id = own.doc_id
), counts AS (
    SELECT g, sum(c) AS n, sum(c * m) AS t FROM held GROUP BY 1
), model AS (
    SELECT *, sum(n) OVER h AS hn, sum(t) OVER h AS ht, sum(n) OVER b AS bn, sum(t) OVER b AS bt, sum(n) OVER () AS an, sum(t) OVER () AS tt
    FROM counts WINDOW h AS (PARTITION BY substr(g, 1, 8)), b AS (PARTITION BY substr(g, 9, 2))
), loss AS (
    SELECT doc_id, c,
           -ln((t - c * m + (bt - cb * m + 1.0::DOUBLE / 256) / (tt - ca * m + 1)) / (ht - ch * m + 1)) AS target,
           -ln((tt / an * (n - c) + (tt / an * (bn - cb) + 1.0::DOUBLE / 256) / (tt / an * (an - ca) + 1)) / (tt / an * (hn - ch) + 1)) AS background
    FROM held JOIN model USING (g)
), mean AS (
    SELECT doc_id, sum(c) AS n, sum(c * target) / sum(c) AS target, sum(c * background) / sum(c) AS background FROM loss GROUP BY 1
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(coalesce(target, 0), 6) AS target_loss,
       round(coalesce(background, 0), 6) AS background_loss, round(coalesce(target - background, 0), 6) AS score
FROM documents LEFT JOIN mean USING (doc_id)
"""


def quality_rules() -> str:
    """Counts, votes and expectation-maximisation, an iteration a table; 40 of them are enough to settle the verdicts."""
    votes, iterations = quality.VOTES, 40
    right, belief, least = quality.RIGHT, quality.BELIEF, quality.LEAST

    def logit(p: str) -> str:
        terms = [
            f"CASE {v} WHEN 1 THEN ln({p}.{v}_good / (1 - {p}.{v}_bad)) WHEN 0 THEN ln((1 - {p}.{v}_good) / {p}.{v}_bad) ELSE 0 END"
            for v in votes
        ]
        return f"1 / (1 + exp(-(ln({p}.good / (1 - {p}.good)) + {' + '.join(terms)})))"

    start = ", ".join(f"{right[k]}::DOUBLE AS {v}_{k}" for v in votes for k in ("good", "bad"))
    steps = [f"m0 AS MATERIALIZED (SELECT {quality.GOOD}::DOUBLE AS good, {start})"]
    for k in range(iterations):
        sums = [f"greatest({least}, (sum(n * q) + {belief * quality.GOOD}) / (sum(n) + {belief})) AS good"]
        for v in votes:
            for side, weight, vote in (("good", "q", 1), ("bad", "(1 - q)", 0)):
                hit = f"coalesce(sum(n * {weight}) FILTER ({v} = {vote}), 0)"
                every = f"coalesce(sum(n * {weight}) FILTER ({v} IS NOT NULL), 0)"
                share = f"({hit} + {belief * right[side]}) / ({every} + {belief})"
                sums.append(f"{f'greatest({least}, {share})' if side == 'good' else share} AS {v}_{side}")
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT {', '.join(sums)} FROM (SELECT c.*, {logit(f'm{k}')} AS q FROM cases c, m{k}))")
    vote = "CASE WHEN {0} IS NULL THEN NULL WHEN {2} THEN 0 WHEN {1} THEN 1 END AS {3}".format
    rules = ", ".join([
        vote("n_words", "n_words >= 40", "n_words < 20", "v_length"),
        vote("wl", "wl BETWEEN 3 AND 10", "wl < 2 OR wl > 15", "v_word_length"),
        vote("sy", "sy <= 0.02", "sy > 0.1", "v_symbols"),
        vote("dl", "dl <= 0.1", "dl > 0.4", "v_dup_lines"),
        vote("rp", "rp <= 0.1", "rp > 0.3", "v_repeats"),
        vote("up", "up <= 0.2", "up > 0.4", "v_upper"),
        vote("le", "le >= 0.85", "le < 0.7", "v_letters"),
        vote("va", "va >= 0.4 OR n_words >= 2000", "va < 0.2 AND n_words < 2000", "v_variety"),
        vote("ma", "ma <= 0.1", "ma > 0.5", "v_marks"),
        vote("ba", "ba <= 0.05", "ba > 0.15", "v_bare"),
    ])
    share = lambda a, b: f"{a}::DOUBLE / nullif({b}, 0)"
    names = ", ".join(votes)
    return rf"""
WITH raw AS (
    SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[ 	-
]+', '', 'g') <> '') AS ls FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM raw)
), twice AS (
    SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1
), counts AS (
    SELECT r.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]+', '', 'g')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls)::BIGINT AS n_lines,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
           len(list_distinct(w)) AS n_distinct, length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters,
           length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks,
           len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]')))::BIGINT AS n_bare
    FROM raw r LEFT JOIN covered USING (doc_id)
), shares AS (
    SELECT *, {share("word_chars", "n_words")} AS wl, {share("n_symbols", "n_words")} AS sy, {share("n_dup_lines", "n_lines")} AS dl,
           {share("n_repeat_words", "n_words")} AS rp, {share("n_upper", "n_letters")} AS up, {share("n_letters", "word_chars")} AS le,
           {share("n_distinct", "n_words")} AS va, {share("n_marks", "n_words")} AS ma, {share("n_bare", "n_words")} AS ba FROM counts
), voted AS MATERIALIZED (SELECT *, {rules} FROM shares),
cases AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM voted GROUP BY {names}),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {logit("p")} >= {quality.THRESHOLD} AS kept
FROM voted, m{iterations} p
"""

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)
"""

#: Words and their leading words within a piece, counted at each length; cuts and containment by joins.
PHRASES = r"""
WITH texts AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT row, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
numbered AS (SELECT row_number() OVER () AS piece_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
spread AS (SELECT piece_id, lang, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM numbered),
windows AS (SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM spread WINDOW p AS (PARTITION BY piece_id ORDER BY pos)),
f1 AS (SELECT lang, w1, count(*) AS f FROM windows GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM windows WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM windows WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.w1, c.w2, NULL AS w3, c.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 c JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  UNION ALL SELECT c.lang, c.w1, c.w2, c.w3, c.f, 1, x.f, y.f FROM f3 c JOIN f1 x USING (lang, w1) JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL SELECT c.lang, c.w1, c.w2, c.w3, c.f, 2, x.f, y.f FROM f3 c JOIN f2 x USING (lang, w1, w2) JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, k) = 1),
around AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
kept AS (SELECT s.*, concat_ws(' ', s.w1, s.w2, s.w3) AS phrase FROM lowest s LEFT JOIN around o ON s.w3 IS NULL AND o.lang = s.lang AND o.w1 = s.w1 AND o.w2 = s.w2
  WHERE o.f IS NULL OR 100 * o.f < 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

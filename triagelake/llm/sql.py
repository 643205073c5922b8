"""SQL counterparts of the operators for DuckDB, with the same parameters."""

from __future__ import annotations

from triagelake.llm import decontam, licenses, lines, manifest, mixing, neardup, negatives, quality, urls

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}')"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)


QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), runs AS (
  SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS run
  FROM d, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS x(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1
), inside AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, {quality.WINDOW})) AS x(k) GROUP BY doc_id
), c AS (
  SELECT doc_id, t, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words
  FROM d LEFT JOIN inside USING (doc_id)
), b AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 5 * n_symbols > n_words OR 5 * n_dup_lines > 2 * len(l)
    OR 2 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > word_chars OR word_chars > 20 * n_words) AS kept
FROM b
"""

NEAR = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({lowered("text")}, '{SPACED}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), {neardup.SHINGLE}) - 1], ' ') AS shingle
  FROM d, unnest(range(1, len(w) - least(len(w), {neardup.SHINGLE}) + 2)) AS x(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
), one AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared.n >= {neardup.PERCENT} * (x.n + y.n - shared.n)
), links AS (
  SELECT a, b FROM one UNION ALL SELECT b, a FROM one
), reach(doc_id, low) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.b, low FROM reach JOIN links ON links.a = reach.doc_id
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(low) AS component_id, doc_id = min(low) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS size,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols,
    (CAST('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / {float(2**48)}::DOUBLE AS u
  FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln(u) / greatest(0.05::DOUBLE, CASE WHEN size + symbols = 0 THEN 1.0 ELSE size::DOUBLE / (size + symbols) END) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM k GROUP BY source
), w AS (
  SELECT *, [{", ".join(f"{x}::DOUBLE" for x in mixing.WEIGHTS)}][(place - 1) % {len(mixing.WEIGHTS)} + 1] AS weight,
    {float(mixing.MAX_EPOCHS)} * source_size AS most FROM s
), l AS (
  SELECT *, most / weight AS ratio,
    ({mixing.TOTAL_SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0.0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM w WINDOW before AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, coalesce(least(most, (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) * weight), most)::DOUBLE AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), m AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN size > 0 AND middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""

DECONTAMINATION = rf"""
WITH i AS (
  SELECT item_id, regexp_extract_all({lowered("text")}, '{PLAIN}') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), {decontam.WINDOW}) AS n, array_to_string(w[k:k + least(len(w), {decontam.WINDOW}) - 1], ' ') AS run
  FROM i, unnest(range(1, len(w) - least(len(w), {decontam.WINDOW}) + 2)) AS x(k) WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all({lowered("text")}, '{PLAIN}') AS w FROM documents
), dw AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS run
  FROM d, (SELECT DISTINCT n FROM iw) AS sizes, unnest(range(1, len(w) - n + 2)) AS x(k)
), hits AS (
  SELECT doc_id, n, k, item_id FROM dw JOIN iw USING (n, run)
), words AS (
  SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT doc_id, n, k FROM hits), unnest(range(0, n)) AS x(j) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names
  FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _pull(n: str = "n", good: str = "good") -> str:
    """Strength of a prior from the spread of its members' rates, as in ``urls._strength``."""
    mean = f"(sum({good}) / sum({n}))"
    noise = f"({mean} * (1 - {mean}))"
    between = (
        f"((sum({good} * {good} / {n}) - sum({n}) * {mean} * {mean} - (count(*) - 1) * {noise})"
        f" / nullif(sum({n}) - sum({n} * {n}) / sum({n}), 0))"
    )
    low, high = urls.STRENGTH
    return (
        f"least({high}::DOUBLE, greatest({low}::DOUBLE, CASE WHEN {between} > 0 THEN {noise} / {between} - 1 ELSE {high}::DOUBLE END))"
    )


_RULES = "\n    ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name} {r.verdict}'"
    for r in sorted(urls.RULES, key=lambda r: (-len(r.name), r.name))
)

URLS = rf"""
WITH r AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^?#]*)', 1) AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
    regexp_extract(rest, '(?s)^[^/]*(/.*)$', 1) AS path FROM r
), o AS (
  SELECT host, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS good FROM p JOIN labels ON doc_id = page_id
  WHERE quality IS NOT NULL GROUP BY host
), h AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
    coalesce(n, 0.0) AS n, coalesce(good, 0.0) AS good
  FROM (SELECT DISTINCT host FROM p) LEFT JOIN o USING (host)
), dom AS (
  SELECT domain, suffix, sum(n) AS n, sum(good) AS good, {_pull()} AS pull FROM h WHERE n > 0 GROUP BY domain, suffix
), suf AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, {_pull()} AS pull FROM dom GROUP BY suffix
), top AS (
  SELECT coalesce(sum(good) / sum(n), 0.5) AS mean, coalesce({_pull()}, {urls.STRENGTH[1]}) AS pull FROM suf
), suf_post AS (
  SELECT suffix, (good + top.pull * mean) / (n + top.pull) AS mean, suf.pull FROM suf, top
), dom_post AS (
  SELECT domain, (good + s.pull * s.mean) / (n + s.pull) AS mean, dom.pull FROM dom JOIN suf_post s USING (suffix)
), prior AS (
  SELECT host, n, good, coalesce(d.mean, s.mean, top.mean) AS mean, coalesce(d.pull, s.pull, top.pull) AS pull
  FROM h CROSS JOIN top LEFT JOIN suf_post s USING (suffix) LEFT JOIN dom_post d USING (domain)
), post AS (
  SELECT host, (good + pull * mean) / (n + pull) AS rate, n + pull AS weight FROM prior
), judged AS (
  SELECT host, rate - {urls.Z} * sqrt(rate * (1 - rate) / (weight + 1)) AS bound FROM post
), ruled AS (
  SELECT *, CASE {_RULES} END AS fits FROM p
)
SELECT page_id, host, path, string_split(fits, ' ')[1] AS rule,
  coalesce(string_split(fits, ' ')[2], CASE WHEN bound < {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN judged USING (host)
"""

# Lines within one edit share a form with one character left out at the same place, or the
# longer one without a character is the shorter.
# The edit distance of SQL counts bytes: letters beyond ASCII are written as control characters first.
_ONE_BYTE = [*range(1, 9), *range(14, 32)]
_NARROW = " || ".join(f"chr({c})" for c in _ONE_BYTE)

_LINE_TABLES = rf"""
WITH raw AS (
  SELECT doc_id, list_filter(
    list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')),
    lambda x: x <> '') AS l
  FROM documents
), each_line AS (
  SELECT doc_id, min(pos) AS pos, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM raw) GROUP BY doc_id, line
), first AS (
  SELECT line, min(doc_id) AS doc, arg_min(pos, doc_id) AS pos, length(line) AS size FROM each_line GROUP BY line
), alphabet AS (
  SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS wide
  FROM (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x7F]')) AS c FROM documents)
), long_lines AS (
  SELECT line, doc, pos, size, size // {lines.PER_EDIT} AS edits, translate(line, left(wide, {len(_ONE_BYTE)}), {_NARROW}) AS flat
  FROM first, alphabet WHERE size >= {lines.PER_EDIT}
), in_parts AS (
  SELECT *, list_transform(range(0, edits + 1),
    lambda k: substr(flat, k * size // (edits + 1) + 1, (k + 1) * size // (edits + 1) - k * size // (edits + 1))) AS parts FROM long_lines
), later AS (
  SELECT DISTINCT CASE WHEN (x.doc, x.pos) > (y.doc, y.pos) THEN x.line ELSE y.line END AS line
  FROM in_parts x JOIN in_parts y ON x.size <= y.size AND y.size - x.size <= y.edits AND x.line <> y.line
  WHERE CASE WHEN len(list_filter(y.parts, lambda s: contains(x.flat, s))) > 0 THEN levenshtein(x.flat, y.flat) <= y.edits ELSE false END
), judged AS (
  SELECT doc_id, line, length(line) AS size, later.line IS NOT NULL OR doc_id > first.doc AS gone
  FROM each_line JOIN first USING (line) LEFT JOIN later USING (line)
)"""

LINES = f"""{_LINE_TABLES}
SELECT doc_id, count(size) AS n_lines, count(*) FILTER (gone) AS n_repeated,
  coalesce(sum(size) FILTER (NOT gone), 0)::BIGINT AS kept_chars
FROM documents LEFT JOIN judged USING (doc_id) GROUP BY doc_id
"""

_KEPT_TEXTS = rf"""{_LINE_TABLES}, cut_up AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), known AS (
  SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS clean FROM cut_up
), stays AS (
  SELECT doc_id, k.line, pos, clean,
    clean = '' OR NOT gone AND row_number() OVER (PARTITION BY doc_id, clean ORDER BY pos) = 1 AS stays
  FROM known k LEFT JOIN judged j USING (doc_id) WHERE clean = '' OR j.line = clean
), rebuilt AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text,
    count(*) FILTER (clean <> '') > 0 AND count(*) FILTER (clean <> '' AND stays) = 0 AS emptied
  FROM (SELECT DISTINCT * FROM stays) GROUP BY doc_id
)
SELECT d.* REPLACE (CASE WHEN d.text IS NOT NULL THEN r.text END AS text)
FROM documents d LEFT JOIN rebuilt r USING (doc_id) WHERE NOT coalesce(emptied, false)
"""

def runs_of(label: str) -> tuple[str, str]:
    """The two runs of words that a block must hold for a label; a blank where there is none."""
    first, second = (licenses.joined_words(of.get(label)) for of in (licenses.TELLING, licenses.VERSIONS))
    return first or " ", second or " "


LICENSES = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({lowered("text")}, '{PLAIN}') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), phrases(words, label) AS (
  VALUES {", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES)}
), base AS (
  SELECT doc_id, k - 1 AS pos, label
  FROM d, phrases, unnest(range(1, len(w) - len(words) + 2)) AS x(k) WHERE w[k:k + len(words) - 1] = words
), t AS (
  SELECT n, label, w AS sequence, list_distinct(w) AS words, ceil({licenses.CONTAINED} * len(list_distinct(w)) - 1e-9) AS needed, first_run, second_run
  FROM (SELECT n, label, first_run, second_run, regexp_extract_all({lowered("text")}, '{PLAIN}') AS w
    FROM (VALUES {values([(i, label, text, *runs_of(label)) for i, (label, text) in enumerate(licenses.TEMPLATES)])}) AS v(n, label, text, first_run, second_run))
), near AS (
  SELECT doc_id, w, l, t.* FROM (SELECT *, list_distinct(w) AS held FROM d) AS d, t WHERE len(list_intersect(words, held)) >= needed
), blocks AS (
  SELECT doc_id, label, words, needed, first_run, second_run, regexp_extract_all({lowered("line")}, '{PLAIN}') AS b
  FROM (SELECT *, unnest(l) AS line FROM near)
  UNION ALL
  SELECT doc_id, label, words, needed, first_run, second_run, w[k:k + 2 * len(sequence) - 1]
  FROM near, unnest(range(1, len(w) + 1, greatest(1, len(sequence) // 2))) AS x(k)
), found AS (
  SELECT doc_id, label, len(list_intersect(words, list_distinct(b)))::DOUBLE / len(words) AS score FROM blocks
  WHERE len(list_intersect(words, list_distinct(b))) >= needed
    AND contains(' ' || array_to_string(b, ' ') || ' ', first_run) AND contains(' ' || array_to_string(b, ' ') || ' ', second_run)
), per_doc AS (
  SELECT doc_id, count(*) AS n, min(pos) AS low, max(pos) AS high, list(DISTINCT label) AS labels FROM base GROUP BY doc_id
), matched AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_base, p.low AS first_word, p.high AS last_word,
  coalesce(array_to_string(list_sort(p.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  coalesce(m.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN per_doc p USING (doc_id) LEFT JOIN matched m USING (doc_id)
"""


def over(body: str, stage: str) -> str:
    """The same SQL over the rows of ``stage`` instead of all documents."""
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}documents AS (SELECT * FROM {stage}), {body.removeprefix(start)}"
    raise ValueError("SQL that starts with WITH is wanted")


PIPELINE = f"""
WITH good AS (
  SELECT d.* FROM documents d JOIN ({QUALITY}) q USING (doc_id) WHERE q.kept
), lined AS ({over(_KEPT_TEXTS, "good")}
), single AS (
  SELECT d.* FROM lined d JOIN ({over(NEAR, "lined")}) q USING (doc_id) WHERE q.kept
), clean AS (
  SELECT d.* FROM single d JOIN ({over(DECONTAMINATION, "single")}) q USING (doc_id) WHERE NOT q.contaminated
)
SELECT d.*, unnest(range(1, taken // size + 1))::INT AS epoch FROM clean d JOIN ({over(MIXING, "clean")}) q USING (doc_id) WHERE taken > 0
"""


def _leaf(n_chars: str = "n_chars") -> str:
    """The digest of a row of documents."""
    fields = [n_chars if f == "n_chars" else f for f in manifest.FIELDS]
    parts = [f"coalesce(strlen(({f})::VARCHAR)::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields]
    return f"sha256({' || '.join(parts)})"


_CRC32 = """xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT),
  lambda c, b: list_reduce(range(0, 8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295)"""


def _climb(name: str, leaves: str) -> str:
    """Recursive table of all nodes above (g, pos, n, digest)."""
    return f"""{name} AS (
  SELECT g, 0 AS level, pos, n, digest FROM {leaves}
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, level, pos // 2, n
)"""


MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('=' || lang, '-') AS g, {_leaf()} AS leaf,
    {_leaf(f"CASE WHEN {_CRC32} % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS seen FROM documents
), leaves AS (
  SELECT doc_id, g, leaf AS digest, leaf, seen, count(*) OVER (PARTITION BY g) AS n,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), {_climb("low", "leaves")}, subroots AS (
  SELECT '' AS g, g AS name, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), {_climb("high", "subroots")}, steps AS (
  SELECT g, level, count(*) OVER (PARTITION BY g) AS levels FROM (SELECT DISTINCT g, level FROM low WHERE n > 1)
), path AS (
  SELECT l.g, l.pos AS leaf_pos, t.level, s.digest AS beside, (l.pos >> t.level) % 2 = 1 AS is_left
  FROM leaves l JOIN steps t USING (g) LEFT JOIN low s ON s.g = l.g AND s.level = t.level AND s.pos = xor(l.pos >> t.level, 1)
  UNION ALL
  SELECT l.g, l.pos, coalesce((SELECT max(levels) FROM steps x WHERE x.g = l.g), 0) + t.level, s.digest, (r.pos >> t.level) % 2 = 1
  FROM leaves l JOIN subroots r ON r.name = l.g CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) t
  LEFT JOIN high s ON s.level = t.level AND s.pos = xor(r.pos >> t.level, 1)
), folded AS (
  SELECT g, pos, 0 AS level, seen AS digest FROM leaves
  UNION ALL
  SELECT f.g, f.pos, f.level + 1, sha256(CASE WHEN beside IS NULL THEN digest WHEN is_left THEN beside || digest ELSE digest || beside END)
  FROM folded f JOIN path p ON p.g = f.g AND p.leaf_pos = f.pos AND p.level = f.level
), ends AS (
  SELECT g, pos, arg_max(digest, level) AS folded_root FROM folded GROUP BY g, pos
), proofs AS (
  SELECT g, leaf_pos AS pos, coalesce(string_agg(beside, '' ORDER BY level), '') AS proof FROM path GROUP BY g, leaf_pos
)
SELECT doc_id, leaf, r.digest AS subroot, t.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = t.digest AS verified
FROM leaves l JOIN subroots r ON r.name = l.g CROSS JOIN (SELECT digest FROM high WHERE n = 1) t
JOIN ends e ON e.g = l.g AND e.pos = l.pos LEFT JOIN proofs p ON p.g = l.g AND p.pos = l.pos
"""

NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, id, score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {negatives.POSITIVES}
)
SELECT anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id))::INT AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n USING (anchor_id)
WHERE NOT alike AND {negatives.LOW} * p.score <= 100 * n.score AND 100 * n.score <= {negatives.HIGH} * p.score
QUALIFY rank <= {negatives.NEGATIVES}
"""

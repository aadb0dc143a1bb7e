"""DuckDB SQL for the training-data queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from . import fingerprint as P
from . import secret_scan as S
from . import suffix_dedup as D

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(name: str, source: str, text: str, pattern: str, keys: str) -> str:
    """CTEs: name(keys, i, before, m, lo, hi) for each match and a last row without match for the rest."""
    p = _quoted(pattern)
    return f"""{name}_0 AS (SELECT {keys}, unnest(regexp_split_to_array({text}, {p})) before, unnest(list_append(regexp_extract_all({text}, {p}), NULL)) m,
generate_subscripts(regexp_split_to_array({text}, {p}), 1) i FROM {source}),
{name} AS (SELECT *, sum(length(before) + coalesce(length(m), 0)) OVER (PARTITION BY {keys} ORDER BY i) hi,
sum(length(before) + coalesce(length(m), 0)) OVER (PARTITION BY {keys} ORDER BY i) - coalesce(length(m), 0) lo FROM {name}_0)"""


def secrets() -> str:
    runs = "|".join(f"{'[+]' if c == '+' else c}{{8,}}" for c in _LETTERS)
    allowed = rf"{S.UUID}|[^/=]{{0,{S.AROUND}}}{S.PLACEHOLDER}[^/=]{{0,{S.AROUND}}}|{runs}"
    most = {k: S._MOST[b] for k, b in (("hex", S.HEX_BITS), ("mixed", S.MIXED_BITS), ("letter", S.LETTER_BITS))}
    n = S.WINDOW
    named = lambda c: f"CASE {c} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(S.KINDS)) + " END"
    written = f"coalesce(string_agg({named('kind')} || ':' || lo || ':' || hi, ',' ORDER BY lo, kind, hi), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
{_matches("a", "d", "t", S.ASSIGN, "doc_id")}, {_matches("k", "d", "t", S.ACCESS, "doc_id")}, {_matches("h", "d", "t", S.HEX, "doc_id")}, {_matches("c", "d", "t", S.CANDIDATE, "doc_id")},
v AS (SELECT doc_id, unnest(regexp_extract_all(t, {_quoted(S.ASSIGN)}, 2)) v, generate_subscripts(regexp_extract_all(t, {_quoted(S.ASSIGN)}, 2), 1) i FROM d),
lead AS (SELECT doc_id, lo c, lo + length(regexp_extract(m, '^/?([a-z]+/)+')) start, substr(m, length(regexp_extract(m, '^/?([a-z]+/)+')) + 1) rest FROM c WHERE m IS NOT NULL),
{_matches("q", "lead", "rest", allowed, "doc_id, c, start")},
part AS (SELECT doc_id, start + lo - length(before) at_, before w FROM q WHERE length(before) >= {S.SHORTEST}),
class AS (SELECT *, CASE WHEN regexp_full_match(w, '[0-9a-fA-F]+') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-fA-F]') THEN {most["hex"]}
WHEN regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') OR regexp_matches(w, '[a-z][a-z]|[A-Z][A-Z]') AND length(regexp_replace(w, '[^0-9]', '', 'g')) >= 4 THEN {most["mixed"]}
WHEN regexp_matches(w, '[A-Za-z]') THEN {most["letter"]} END most FROM part),
win AS (SELECT doc_id, at_, most, unnest(range(0, length(w) - {n - 1})) i, w FROM class WHERE most IS NOT NULL),
ch AS (SELECT doc_id, at_, most, i, string_split(substr(w, i + 1, {n}), '') x FROM win),
hot AS (SELECT doc_id, at_, i FROM ch WHERE list_sum(list_transform(list_distinct(x), lambda y: {S.TERMS}[len(list_filter(x, lambda z: z = y)) + 1])) <= most),
isle AS (SELECT *, sum(CASE WHEN i - {n} <= before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, at_ ORDER BY i) g FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, at_ ORDER BY i) before FROM hot)),
spans AS (SELECT doc_id, 0 kind, lo, hi FROM a JOIN v USING (doc_id, i) WHERE length(v) >= 8 UNION ALL SELECT doc_id, 1, lo, hi FROM k WHERE m IS NOT NULL UNION ALL SELECT doc_id, 2, lo, hi FROM h WHERE m IS NOT NULL
UNION ALL SELECT doc_id, 3, at_ + min(i), at_ + max(i) + {n} FROM isle GROUP BY doc_id, at_, g),
all_of AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {k}) n_{name}" for k, name in enumerate(S.KINDS))}, {written} spans FROM spans GROUP BY doc_id),
base AS (SELECT doc_id, {written} spans FROM spans WHERE kind < 3 GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{name}, 0) n_{name}" for name in S.KINDS)}, sha256(coalesce(base.spans, '')) base_sha256, coalesce(all_of.spans, '') spans
FROM d LEFT JOIN all_of ON d.doc_id = all_of.doc_id LEFT JOIN base ON d.doc_id = base.doc_id"""


_WHITE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate({text}, '{P._UPPER}', '{P._LOWER}'), '{_WHITE}'), lambda w: w <> '')"


def _shingles(name: str, source: str, text: str, keys: str, n: int) -> str:
    """CTEs: name(keys, s) with each run of n words, joined by spaces; of texts with fewer words the whole sequence."""
    following = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])
    return f"""{name}_w AS (SELECT {keys}, {_words(text)} x FROM {source}), {name}_e AS (SELECT {keys}, unnest(x) w, generate_subscripts(x, 1) i FROM {name}_w WHERE len(x) >= {n}),
{name} AS (SELECT {keys}, s FROM (SELECT {keys}, {following} s FROM {name}_e WINDOW o AS (PARTITION BY {keys} ORDER BY i)) WHERE s IS NOT NULL
UNION ALL SELECT {keys}, array_to_string(x, ' ') FROM {name}_w WHERE len(x) BETWEEN 1 AND {n - 1})"""


def fingerprints() -> str:
    limit = f"{round(P.FRACTION * 16**8):08x}"
    share = lambda a, b, x, y: f"CASE WHEN {x} = {y} THEN 1.0 WHEN coalesce(len({a}), 0) = 0 THEN 0.0 ELSE len(list_intersect({a}, coalesce({b}, [])))::DOUBLE / len({a}) END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
n AS (SELECT doc_id, t, length(t) n, length(t) // 2 half, coalesce(lead(t) OVER o, first_value(t) OVER o) nt, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) next_id FROM d WINDOW o AS (ORDER BY doc_id)),
both_of AS (SELECT doc_id, 0 e, t FROM n UNION ALL SELECT doc_id, 1, left(t, n - half) || left(nt, half) FROM n),
{_shingles("s", "both_of", "t", "doc_id, e", P.WORDS)}, h AS (SELECT DISTINCT doc_id, e, left(md5(s), {P.DIGITS}) h FROM s),
k AS (SELECT doc_id, e, list(h ORDER BY h) k FROM h WHERE h < '{limit}' GROUP BY ALL),
r AS (SELECT n.*, et.t et, a.k ts, b.k es, c.k ns FROM n JOIN both_of et ON et.doc_id = n.doc_id AND et.e = 1 LEFT JOIN k a ON a.doc_id = n.doc_id AND a.e = 0 LEFT JOIN k b ON b.doc_id = n.doc_id AND b.e = 1 LEFT JOIN k c ON c.doc_id = n.next_id AND c.e = 0)
SELECT doc_id, n::BIGINT n_chars, sha256(et) edited_sha256, coalesce(array_to_string(ts, ''), '') fingerprint, coalesce(array_to_string(es, ''), '') edited_fingerprint,
{share("ts", "es", "t", "et")} near_edited, {share("ts", "ns", "t", "nt")} near_next FROM r"""


def _reached(ids: str, links: str) -> str:
    """CTE reached(id, least): the least of what links reach from each id, itself included; links has both directions."""
    return f"""walk AS (SELECT id, id r FROM {ids} UNION SELECT walk.id, l.b FROM walk JOIN {links} l ON walk.r = l.a), reached AS (SELECT id, min(r) least FROM walk GROUP BY id)"""


def vectors(least: float = 0.98) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) n FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= {least}),
ids AS (SELECT vec_id id FROM v), {_reached("ids", "links")}, degree AS (SELECT a, count(*) n FROM links GROUP BY a)
SELECT id vec_id, coalesce(n, 0)::BIGINT n_links, least component_id, id = least kept FROM reached LEFT JOIN degree ON degree.a = reached.id"""


def jaccard(words: int = 5) -> str:
    """Documents of equal sets stand together, as one of least id."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') t FROM documents), {_shingles("s", "d", "t", "doc_id", words)},
sets AS (SELECT doc_id, list(DISTINCT s ORDER BY s) x FROM s GROUP BY doc_id), kinds AS (SELECT x, min(doc_id) id, len(x) n FROM sets GROUP BY x), of_kind AS (SELECT doc_id, id FROM sets JOIN kinds USING (x)),
each AS (SELECT id, n, unnest(x) s FROM kinds), pairs AS (SELECT a.id a, b.id b, a.n na, b.n nb, count(*) both_of FROM each a JOIN each b ON a.s = b.s AND a.id < b.id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
one_way AS (SELECT a, b FROM pairs WHERE 100 * both_of >= 75 * (na + nb - both_of)), links AS (SELECT a, b FROM one_way UNION ALL SELECT b, a FROM one_way), ids AS (SELECT id FROM kinds), {_reached("ids", "links")}
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT n_shingles, coalesce(r.least, d.doc_id) component_id FROM d LEFT JOIN of_kind o ON o.doc_id = d.doc_id LEFT JOIN kinds k ON k.id = o.id LEFT JOIN reached r ON r.id = o.id"""


def repeats(length: int = D.LENGTH) -> str:
    """Bytes as two hexadecimal digits each; a byte goes if one of the length strings over it occurs twice. Long texts are cut into overlapping parts, for speed alone."""
    step = 128
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 n FROM d),
part AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * (step + length - 1)}) h FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1}, {step})) p FROM n WHERE n >= {length})),
win AS (SELECT doc_id, p + i at_, md5_number(substr(h, 2 * i + 1, {2 * length})) m FROM (SELECT doc_id, p, h, unnest(range(0, least({step}, length(h) // 2 - {length - 1}))) i FROM part)),
hit AS (SELECT doc_id, at_ FROM win JOIN (SELECT m FROM win GROUP BY m HAVING count(*) > 1) USING (m)),
run AS (SELECT doc_id, min(at_) a, max(at_) + {length} b FROM (SELECT *, sum(CASE WHEN at_ - before <= {length} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY at_) g FROM (SELECT *, lag(at_) OVER (PARTITION BY doc_id ORDER BY at_) before FROM hit)) GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) lo, a hi FROM run UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(n) FROM n LEFT JOIN run USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) k FROM gap JOIN n USING (doc_id) GROUP BY doc_id), runs AS (SELECT doc_id, count(*) c, sum(b - a) r FROM run GROUP BY doc_id)
SELECT doc_id, n::BIGINT n_bytes, coalesce(r, 0)::BIGINT n_removed, coalesce(c, 0)::BIGINT n_spans, sha256(unhex(k)) kept_sha256 FROM n JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)"""


ORACLES = {
    "op3_suffix_dedup": repeats(),
    "op4_embed_dedup": vectors(),
    "op8_secrets": secrets(),
    "op9_jaccard_join": jaccard(),
    "op10_fingerprints": fingerprints(),
}

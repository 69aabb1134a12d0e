"""DuckDB SQL for the queries of :mod:`seqloom.plans.queries`, from the driver's tables on."""

from __future__ import annotations

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CODES = "".join("ACGT"[i % 4] for i in range(26))
_ENC = f"regexp_replace(translate(text, '{_LETTERS}{_LETTERS.upper()}', '{_CODES}{_CODES}'), '[^ACGT]', '', 'g')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


_QUAL = "array_to_string(list_transform(range(1, {n} + 1), lambda p: chr((33 + ({seed} + p * p) % 41)::INT)), '')"

READS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_ENC} AS s, (CASE WHEN doc_id % 25 = 0 THEN 8 + doc_id % 3 ELSE 18 + doc_id % 8 END)::INT AS l FROM documents),
r AS (SELECT doc_id, s, l, unnest(range(0, length(s) // l))::INT AS i FROM d WHERE length(s) >= l),
w AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN {_rc("substr(s, i * l + 1, l)")} ELSE substr(s, i * l + 1, l) END AS w FROM r),
reads AS (SELECT (doc_id % 3)::INT AS sample, 'd' || doc_id || '_' || i AS name,
  CASE WHEN (doc_id + i) % 97 = 0 THEN substr(w, 1, 4) || 'N' || substr(w, 6) ELSE w END AS seq, {_QUAL.format(n="l", seed="doc_id * 7 + i * 3")} AS qual FROM w),
n AS (SELECT sample, name, qual, CASE WHEN contains(seq, 'N') THEN array_to_string(list_transform(range(1, length(seq) + 1), lambda p:
  CASE WHEN substr(seq, p, 1) = 'N' THEN substr('ACGT', ((strpos('0123456789abcdef', substr(md5('42:' || name || ':' || p), 1, 1)) - 1) % 4 + 1)::INT, 1)
       ELSE substr(seq, p, 1) END), '') ELSE seq END AS s FROM reads),
k AS (SELECT * FROM n WHERE length(s) >= 9),
q AS (SELECT DISTINCT s FROM k)
"""

_TRIPLETS = "(SELECT s, e, substr(reverse(s), e - 1, 3) AS t FROM (SELECT s, unnest(range(2, length(s))) AS e FROM {q}))"


def _low(q: str, most: int) -> str:
    """Sequences of ``q`` with a triplet, ending at 0-based 8 or later, that is its (most+1)th."""
    counted = f"(SELECT s, e, count(*) OVER (PARTITION BY s, t ORDER BY e) AS c FROM {_TRIPLETS.format(q=q)})"
    return f"(SELECT DISTINCT s FROM {counted} WHERE e >= 8 AND c > {most})"


def _qualities(k: str) -> str:
    each = f"(SELECT s, p, max(substr(qual, p::INT, 1)) AS c FROM (SELECT s, qual, unnest(range(1, length(s) + 1)) AS p FROM {k}) GROUP BY s, p)"
    return f"(SELECT s, string_agg(c, '' ORDER BY p) AS qual FROM {each} GROUP BY s)"


def _counts(k: str) -> str:
    return f"(SELECT s, {', '.join(f'count(*) FILTER (sample = {i}) AS c{i}' for i in range(3))} FROM {k} GROUP BY s)"


GENOME = f"g AS (SELECT item_id AS rid, {_ENC} AS s, length({_ENC})::BIGINT AS len FROM benchmark)"
STRANDS = f"gs AS (SELECT rid, 1 AS st, s AS t, len FROM g UNION ALL SELECT rid, 0, {_rc('s')}, len FROM g)"


def _swap(x: str, p: str, table: str) -> str:
    return f"(substr({x}, 1, {p} - 1) || translate(substr({x}, {p}, 1), 'ACGT', '{table}') || substr({x}, {p} + 1))"


_EDITED = f"""CASE i % 5 WHEN 0 THEN w WHEN 1 THEN {_swap("w", "(l - i % l)", "CGTA")} WHEN 2 THEN substr(w, 1, 6) || substr(w, 8)
  WHEN 3 THEN substr(w, 1, 9) || 'A' || substr(w, 10) ELSE {_swap(_swap("w", "4", "GTAC"), "12", "TGCA")} END"""

PLANTED = f"""
WITH RECURSIVE {GENOME}, {STRANDS},
pw AS (SELECT rid, i, l, substr(s, i * 7 + 1, l) AS w FROM (SELECT rid, s, (18 + rid % 8)::INT AS l, unnest(range(0, (len - 30) // 7 + 1))::INT AS i FROM g WHERE len >= 37)),
pe AS (SELECT rid, i, {_EDITED} AS x FROM pw),
pr AS (SELECT rid, i, CASE WHEN (rid + i) % 2 = 1 THEN {_rc("x")} ELSE x END AS s FROM pe),
k AS (SELECT (rid % 3)::INT AS sample, 'p' || rid || '_' || i AS name, s, {_QUAL.format(n="length(s)", seed="rid * 7 + i * 3")} AS qual FROM pr),
q AS (SELECT DISTINCT s FROM k)
"""


def _round(e: int, left: str) -> str:
    """CTEs ending in m{e}: places at distance e of the sequences of ``left``."""
    return f"""
p{e} AS (SELECT s, length(s) AS l, (length(s) * j) // {e + 1} AS off, (length(s) * (j + 1)) // {e + 1} - (length(s) * j) // {e + 1} AS k
  FROM {left}, unnest(range(0, {e + 1})) AS x(j)),
x{e} AS (SELECT rid, st, k, p, substr(t, p::INT, k::INT) AS kmer FROM (SELECT rid, st, t, k, unnest(range(1, len - k + 2)) AS p FROM gs, (SELECT DISTINCT k FROM p{e}))),
c{e} AS (SELECT DISTINCT s, l, rid, st, p - off + d AS start FROM p{e} JOIN x{e} ON x{e}.k = p{e}.k AND kmer = substr(s, off::INT + 1, p{e}.k::INT),
  unnest(range(-{e}, {e + 1})) AS y(d)),
m{e} AS (SELECT s, rid, st, start, glen, substr(t, start::INT, glen::INT) AS g, {e} AS n_errors
  FROM (SELECT s, c{e}.rid, c{e}.st, start, l + d AS glen, t, len FROM c{e} JOIN gs ON gs.rid = c{e}.rid AND gs.st = c{e}.st, unnest(range(-{e}, {e + 1})) AS y(d))
  WHERE start >= 1 AND start + glen - 1 <= len AND glen > 0 AND levenshtein(s, substr(t, start::INT, glen::INT)) = {e})"""


def _places(errors: int, first: str = "q") -> str:
    out = [_round(0, first)]
    for e in range(1, errors + 1):
        before = " UNION ".join(f"SELECT s FROM m{i}" for i in range(e))
        out.append(f"u{e} AS (SELECT s FROM {first} WHERE s NOT IN ({before}))")
        out.append(_round(e, f"u{e}"))
    return ", ".join(out) + f", places AS ({' UNION ALL '.join(f'SELECT * FROM m{i}' for i in range(errors + 1))})"


HITS = """,
i1 AS (SELECT *, (CASE WHEN length(s) <> glen THEN abs(length(s) - glen) WHEN hamming(s, g) = n_errors THEN 0 ELSE 2 END)::BIGINT AS n_indels,
  count(*) OVER (PARTITION BY s, g) AS occ FROM places),
i2 AS (SELECT * FROM i1 QUALIFY row_number() OVER (PARTITION BY s, rid, st, start, occ ORDER BY n_indels, glen) = 1),
hits AS (SELECT i2.*, count(*) OVER (PARTITION BY i2.s) AS n_hits_raw, CASE WHEN st = 1 THEN start ELSE len - start - glen + 2 END AS pos
  FROM i2 JOIN (SELECT rid AS r, len FROM g) ON r = i2.rid)
"""

DEDUP = """,
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY rid, pos, st, n_indels, glen, g) AS n FROM hits WHERE n_hits_raw <= 5),
f AS (SELECT s, n, 1::BIGINT AS hi, rid AS a_rid, st AS a_st, pos AS a_pos FROM o WHERE n = 1
  UNION ALL
  SELECT s, n, CASE WHEN near THEN hi ELSE hi + 1 END, CASE WHEN near THEN a_rid ELSE rid END, CASE WHEN near THEN a_st ELSE st END, CASE WHEN near THEN a_pos ELSE pos END
  FROM (SELECT o.s, o.n, f.hi, a_rid, a_st, a_pos, o.rid, o.st, o.pos, o.rid = a_rid AND o.st = a_st AND o.pos - a_pos <= o.n_errors AS near
        FROM f JOIN o ON o.s = f.s AND o.n = f.n + 1)),
dd AS (SELECT o.*, hi FROM o JOIN f ON o.s = f.s AND o.n = f.n QUALIFY row_number() OVER (PARTITION BY o.s, hi ORDER BY n_indels, o.n) = 1),
rep AS (SELECT *, count(*) OVER (PARTITION BY s) AS nh FROM dd),
fl AS (SELECT *, ((st = 0)::INT * 16 + (hi <> 1)::INT * 256)::BIGINT AS flag, (CASE WHEN nh > 1 OR n_errors >= 40 THEN 0 ELSE 40 - n_errors END)::BIGINT AS mapq FROM rep)
"""

_SINGLE = """
lc AS (SELECT *, length(s) AS l,
  coalesce(list_min(list_filter(range(1, least(length(s), glen)::BIGINT + 1), lambda p: substr(s, p::INT, 1) <> substr(g, p::INT, 1))) - 1, least(length(s), glen)) AS pre,
  coalesce(list_min(list_filter(range(1, least(length(s), glen)::BIGINT + 1), lambda p: substr(reverse(s), p::INT, 1) <> substr(reverse(g), p::INT, 1))) - 1, least(length(s), glen)) AS suf
  FROM fl WHERE n_errors <= 1),
ed AS (SELECT *, CASE WHEN n_errors = 0 THEN l WHEN l = glen THEN pre WHEN l > glen THEN l - 1 - least(suf, l - 1) ELSE l - least(suf, l) END AS a,
  CASE WHEN n_errors = 0 THEN '' WHEN l = glen THEN '1X' WHEN l > glen THEN '1I' ELSE '1D' END AS op FROM lc),
eb AS (SELECT *, CASE WHEN n_errors = 0 THEN 0 WHEN l < glen THEN l - a ELSE l - 1 - a END AS b FROM ed),
cg1 AS (SELECT s, hi, rid, pos, st, CASE WHEN st = 1 THEN (CASE WHEN a > 0 THEN a || '=' ELSE '' END) || op || (CASE WHEN b > 0 THEN b || '=' ELSE '' END)
  ELSE (CASE WHEN b > 0 THEN b || '=' ELSE '' END) || op || (CASE WHEN a > 0 THEN a || '=' ELSE '' END) END AS cigar FROM eb)"""

# two errors: every pair of edits, with a equal bases before the first and b between them, that turns the read into g
_DOUBLE = """
ty(t, r, ds, dg) AS (VALUES ('X', 0, 1, 1), ('I', 1, 1, 0), ('D', 2, 0, 1)),
e1 AS (SELECT fl.*, length(fl.s) AS l, unnest(range(0, least(length(fl.s), glen)::BIGINT + 1)) AS a FROM fl WHERE n_errors = 2),
e2 AS (SELECT e1.*, x.t AS t1, x.r AS r1, x.ds AS ds1, x.dg AS dg1, y.t AS t2, y.r AS r2, y.ds AS ds2, y.dg AS dg2
  FROM e1, ty AS x, ty AS y WHERE substr(s, 1, a::INT) = substr(g, 1, a::INT) AND l - x.ds - y.ds = glen - x.dg - y.dg
    AND (x.ds <> x.dg)::INT + (y.ds <> y.dg)::INT = n_indels AND (x.t <> 'X' OR substr(s, a::INT + 1, 1) <> substr(g, a::INT + 1, 1))),
e3 AS (SELECT *, l - a - ds1 - b - ds2 AS c FROM (SELECT *, unnest(range(0, l - a - ds1 - ds2 + 1)) AS b FROM e2 WHERE l - a - ds1 - ds2 >= 0)),
e4 AS (SELECT * FROM e3 WHERE substr(s, (a + ds1)::INT + 1, b::INT) = substr(g, (a + dg1)::INT + 1, b::INT)
    AND (t2 <> 'X' OR substr(s, (a + ds1 + b)::INT + 1, 1) <> substr(g, (a + dg1 + b)::INT + 1, 1))
    AND substr(s, (a + ds1 + b + ds2)::INT + 1) = substr(g, (a + dg1 + b + dg2)::INT + 1)
  QUALIFY row_number() OVER (PARTITION BY s, hi ORDER BY a, r1, b, r2) = 1),
e5 AS (SELECT *, CASE WHEN a > 0 THEN a || '=' ELSE '' END AS fa, CASE WHEN c > 0 THEN c || '=' ELSE '' END AS fc, CASE WHEN b > 0 THEN b || '=' ELSE '' END AS fb FROM e4),
cg2 AS (SELECT s, hi, rid, pos, st, CASE WHEN b = 0 AND t1 = t2 THEN (CASE WHEN st = 1 THEN fa || '2' || t1 || fc ELSE fc || '2' || t1 || fa END)
    WHEN st = 1 THEN fa || '1' || t1 || fb || '1' || t2 || fc ELSE fc || '1' || t2 || fb || '1' || t1 || fa END AS cigar FROM e5),
cg AS (SELECT * FROM cg1 UNION ALL SELECT * FROM cg2)"""

_BODY = f""",
ql AS {_qualities("k")},
body AS (
  SELECT fl.s, flag, fl.rid::VARCHAR AS rname, fl.pos, mapq, CASE WHEN fl.st = 0 THEN {_rc("fl.s")} ELSE fl.s END AS seq,
    CASE WHEN fl.st = 0 THEN reverse(qual) ELSE qual END AS qual, nh, fl.hi, n_errors::BIGINT AS nm, cigar
  FROM fl JOIN ql ON ql.s = fl.s JOIN cg ON cg.s = fl.s AND cg.hi = fl.hi
  UNION ALL
  SELECT h.s, 4, '*', 0, CASE WHEN nh > 1 THEN 0 ELSE 40 - nm END, h.s, qual, nh, 0, nm, '*'
  FROM (SELECT s, max(n_hits_raw) AS nh, max(n_errors) AS nm FROM hits WHERE n_hits_raw > 5 GROUP BY s) AS h JOIN ql ON ql.s = h.s)
"""
_FIELDS = "cigar, flag::BIGINT AS flag, rname, pos::BIGINT AS pos, mapq::BIGINT AS mapq, '*' AS rnext, 0::BIGINT AS pnext, 0::BIGINT AS tlen, seq, qual, nh::BIGINT AS nh, hi::BIGINT AS hi, nh::BIGINT AS ih, nm::BIGINT AS nm"
_COMPLEX = PLANTED.replace("q AS (SELECT DISTINCT s FROM k)", "k0 AS (SELECT * FROM k1 WHERE length(s) >= 9), k AS (SELECT * FROM k0 WHERE s NOT IN " + _low("k0", 6) + "), q AS (SELECT DISTINCT s FROM k)").replace("\nk AS (SELECT (rid", "\nk1 AS (SELECT (rid")


def oracle_sql() -> dict[str, str]:
    places = PLANTED + ", " + _places(2)
    hits = places + HITS
    flagged = hits + DEDUP
    mapped = _COMPLEX + ", " + _places(2) + HITS + DEDUP + "," + _SINGLE + "," + _DOUBLE + _BODY
    dumped = f"ok AS (SELECT * FROM k WHERE s NOT IN {_low('q', 6)}), c AS {_counts('ok')}, ql AS {_qualities('ok')}"
    prefixes = """pf AS (SELECT DISTINCT e, substr(reverse(s), 1, e::INT) AS x FROM (SELECT s, unnest(range(0, length(s) + 1)) AS e FROM q)),
ch AS (SELECT e - 1 AS e, substr(x, 1, e::INT - 1) AS x, count(*) AS n FROM pf WHERE e > 0 GROUP BY ALL),
pn AS (SELECT pf.e, pf.x, coalesce(n, 0)::BIGINT AS n FROM pf LEFT JOIN ch ON pf.e = ch.e AND pf.x = ch.x)"""
    return {
        "normalize": READS + "SELECT sample, name, s, qual FROM n",
        "revcomp": READS + f"SELECT name, {_rc('s')} AS rc, translate(s, 'ACGT', 'TGCA') AS c, reverse(qual) AS back_qual FROM n",
        "kmer_code": READS + "SELECT name, list_sum(list_transform(range(1, 9), lambda p: (strpos('ACGT', substr(s, length(s) - p::INT + 1, 1)) - 1) * pow(4, 8 - p)))::BIGINT AS code FROM k",
        "filter_length": READS + "SELECT sample, name, s FROM k",
        "read_stats": READS + "SELECT count(*) AS n_reads, max(length(s))::BIGINT AS max_length, count(DISTINCT s) FILTER (length(s) >= 9) AS n_sequences FROM n",
        "collapse_counts": READS + f"SELECT * FROM {_counts('k')}",
        "collapse_quality": READS + f"SELECT * FROM {_qualities('k')}",
        "collapse_names": READS + "SELECT s, sample, string_agg(name, ' ' ORDER BY name) AS names FROM k GROUP BY s, sample",
        "triplet_counts": READS + f"SELECT s, t AS triplet, count(*) AS n FROM {_TRIPLETS.format(q='q')} GROUP BY s, t",
        "low_complexity": READS + f"SELECT s FROM {_low('q', 6)}",
        "low_complexity_f3": READS + f"SELECT s FROM {_low('q', 3)}",
        "collapsed_dump": READS
        + f""", {dumped}, nn AS (SELECT c.*, qual, row_number() OVER (ORDER BY reverse(c.s)) AS n FROM c JOIN ql ON ql.s = c.s)
SELECT n, '@read' || n || '__' || c0 || '_' || c1 || '_' || c2 || chr(10) || s || chr(10) || '+' || chr(10) || qual AS record FROM nn""",
        "prefix_stats": READS + f", {prefixes} SELECT e AS depth, n AS children, count(*) AS nodes FROM pn GROUP BY ALL",
        "branch_lengths": READS
        + f""", {prefixes}, up AS (SELECT o.x, max(a) AS a FROM (SELECT x, unnest(range(0, e)) AS a FROM pn WHERE n <> 1) AS o JOIN pn AS b ON b.n > 1 AND b.e = a AND b.x = substr(o.x, 1, a::INT) GROUP BY o.x)
SELECT pn.e - coalesce(up.a + 1, 0) AS length, count(*) AS branches FROM pn LEFT JOIN up ON pn.x = up.x WHERE n <> 1 GROUP BY ALL""",
        "read_nodes": READS + f", {prefixes} SELECT count(*) AS nodes, count(*) FILTER (x IN (SELECT reverse(s) FROM q)) AS read_nodes FROM pf WHERE e > 0",
        "genome_contigs": f"WITH {GENOME} SELECT rid, s, len FROM g",
        "sam_header": f"WITH {GENOME} SELECT 0::BIGINT AS n, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' AS line UNION ALL SELECT rid + 1, '@SQ' || chr(9) || 'SN:' || rid || chr(9) || 'LN:' || len FROM g",
        **{f"map_reads_e{e}": READS + f", {GENOME}, {STRANDS}, {_places(e)} SELECT s, rid, st, start{'' if e == 0 else ', glen::BIGINT AS glen'} FROM {'places' if e == 0 else f'm{e}'}" for e in range(3)},
        **{f"map_e{e}": PLANTED + f", {_places(e)} SELECT s, rid, st, start, glen FROM m{e}" for e in range(3)},
        "best_stratum": places + "SELECT s, min(n_errors)::BIGINT AS n_errors, count(*) AS places FROM places GROUP BY s",
        "nhits_raw": hits + "SELECT DISTINCT s, n_hits_raw FROM hits",
        "too_many_hits": hits + "SELECT s, max(n_hits_raw) AS nh, max(n_errors)::BIGINT AS nm FROM hits WHERE n_hits_raw > 1 GROUP BY s",
        "hit_positions": hits + "SELECT s, rid, st, pos, glen, n_indels FROM hits",
        "hits_dedup": flagged + "SELECT s, rid, st, pos, glen, n_indels, nh FROM fl",
        "hit_index": flagged + "SELECT s, rid, pos, st, hi FROM fl",
        "mapq_flag": flagged + "SELECT s, rid, pos, flag, mapq FROM fl",
        "cigar_single": flagged + "," + _SINGLE + " SELECT s, rid, pos, st, cigar FROM cg1",
        "cigar": flagged + "," + _SINGLE + "," + _DOUBLE + " SELECT s, rid, pos, st, cigar FROM cg",
        "sam_text": mapped
        + """ SELECT sample, concat_ws(chr(9), name, flag, rname, pos, mapq, cigar, '*', 0, 0, seq, body.qual, 'NH:i:' || nh, 'HI:i:' || hi, 'IH:i:' || nh, 'NM:i:' || nm) AS line
FROM k JOIN body ON body.s = k.s""",
        "sam_lines": mapped + f"SELECT sample, name AS qname, {_FIELDS.replace(' qual,', ' body.qual,')} FROM k JOIN body ON body.s = k.s",
        "sam_unified": mapped
        + f""", cn AS {_counts("k")}, fn AS (SELECT s, arg_min(name, (sample, name)) AS name FROM k GROUP BY s)
SELECT name || '_' || c0 || '_' || c1 || '_' || c2 AS qname, {_FIELDS} FROM body JOIN cn ON cn.s = body.s JOIN fn ON fn.s = body.s""",
        "fastq_scan": READS + "SELECT name, seq, qual FROM reads",
    }

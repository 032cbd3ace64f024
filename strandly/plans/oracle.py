"""SQL twins, for DuckDB, of the queries."""

from __future__ import annotations

from .derived import A_ROWS, B_ALT, B_ROWS, INTERVAL, NUMBERED, SAMPLES, VARIANT, listed

V = f"variants AS MATERIALIZED (SELECT {listed(VARIANT)} FROM lineitem)"
CA = f"calls_a AS MATERIALIZED (SELECT {listed(VARIANT)} FROM lineitem WHERE {A_ROWS})"
CB = f"calls_b AS MATERIALIZED (SELECT {listed(VARIANT | {'alt': B_ALT})} FROM lineitem WHERE {B_ROWS})"
IV = f"iv AS MATERIALIZED (SELECT {listed(INTERVAL)} FROM orders)"


def alleles(source: str, name: str) -> str:
    """CTEs that normalise and classify the alleles of a call set."""
    return f"""
{name}1 AS (SELECT v.*, string_split(alt, ',') AS alts FROM {source} v),
{name}2 AS (SELECT *, unnest(alts) AS allele, unnest(range(len(alts))) AS aid FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN (length(ref) = 1 AND length(allele) = 1) OR allele LIKE '<%' OR allele LIKE '%[%' OR allele LIKE '%]%' THEN -1
  ELSE list_max(list_filter(range(0, least(length(ref), length(allele))), lambda k: right(ref, k::int) = right(allele, k::int))) END AS sfx FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN sfx < 0 THEN ref ELSE left(ref, (length(ref) - sfx)::int) END AS r, CASE WHEN sfx < 0 THEN allele ELSE left(allele, (length(allele) - sfx)::int) END AS a FROM {name}3),
{name}5 AS (SELECT *, CASE WHEN sfx < 0 THEN 0 ELSE list_max(list_filter(range(0, least(length(r), length(a))), lambda k: left(r, k::int) = left(a, k::int))) END AS pfx FROM {name}4),
{name}6 AS (SELECT *, (pos + pfx)::int AS npos, substr(r, (pfx + 1)::int) AS nref, substr(a, (pfx + 1)::int) AS nalt FROM {name}5),
{name}7 AS (SELECT *, CASE WHEN allele LIKE '<%' THEN 'sv' WHEN allele LIKE '%[%' OR allele LIKE '%]%' THEN 'rearrangement'
  WHEN length(nref) = 1 AND length(nalt) = 1 THEN 'snp' WHEN length(nref) = length(nalt) THEN 'mnp'
  WHEN length(nref) = 1 AND left(nref, 1) = left(nalt, 1) THEN 'ins' WHEN length(nalt) = 1 AND left(nref, 1) = left(nalt, 1) THEN 'del' ELSE 'complex' END AS cls FROM {name}6),
{name} AS MATERIALIZED (SELECT *, CASE WHEN cls = 'snp' THEN (count(*) FILTER (cls = 'snp') OVER (PARTITION BY record_id) + 1)::int END AS snp_arity,
  cls = 'snp' AND count(*) FILTER (cls = 'snp') OVER (PARTITION BY record_id) > 1 AND aid = min(aid) FILTER (cls = 'snp') OVER (PARTITION BY record_id) AS multi_first FROM {name}7)"""


AL = f"WITH {V}, {alleles('variants', 'al')}"
AB = f"WITH {CA}, {CB}, {alleles('calls_a', 'a')}, {alleles('calls_b', 'b')}"
COLS = "record_id, chrom, npos, aid::int AS aid, nref, nalt, cls"
KEY = "chrom, npos, cls, nref, nalt"
SITE = "chrom, npos, cls"


def match(x: str, y: str, key: str) -> str:
    return " AND ".join(f"{x}.{k} = {y}.{k}" for k in key.split(", "))


LOOSE = "('sv', 'rearrangement')"
ENTRIES = "string_split(info, ';')"
FILTERS = "list_filter(string_split(flt, ';'), lambda x: x <> '.')"


def ts(r: str = "nref", a: str = "nalt") -> dict[str, str]:
    pair = f"concat({r}, {a})"
    return {
        "ts": f"{pair} IN ('AG', 'GA', 'CT', 'TC')",
        "tv": f"{pair} IN ('AC', 'CA', 'AT', 'TA', 'CG', 'GC', 'GT', 'TG')",
        "deam": f"{pair} IN ('CT', 'GA')",
        "am": f"{pair} IN ('TC', 'AG')",
    }


def div(n: str, d: str, scale: str = "1.0") -> str:
    return f"round(coalesce({scale} * ({n}) / nullif(({d})::double, 0), 0), 6)"


CHANGES = ", ".join(f"count(*) FILTER (cls = 'snp' AND snp_arity = 2 AND {c} AND {'rsid = ' if who == 'novel' else 'rsid <> '}'.') AS {who}_{k}" for k, c in ts().items() for who in ("novel", "known"))
RATIOS = ", ".join(
    f"{x} AS {n}"
    for n, x in {
        "pct_dbsnp": div("known_ts + known_tv", "novel_ts + novel_tv + known_ts + known_tv + multi", "100.0"),
        "tstv": div("novel_ts + known_ts", "novel_tv + known_tv"),
        "novel_tstv": div("novel_ts", "novel_tv"),
        "known_tstv": div("known_ts", "known_tv"),
        "deam_am": div("novel_deam + known_deam", "novel_am + known_am"),
        "novel_deam_am": div("novel_deam", "novel_am"),
        "known_deam_am": div("known_deam", "known_am"),
    }.items()
)
BY_FILTER = f"""{AL},
x AS (SELECT *, unnest(list_concat(['all'], CASE WHEN flt = '.' THEN ['.'] ELSE string_split(flt, ';') END)) AS ft FROM al),
g AS (SELECT coalesce(chrom, 'total') AS chrom, ft, {CHANGES}, count(*) FILTER (multi_first) AS multi, count(*) FILTER (cls = 'mnp') AS mnp, count(*) FILTER (cls = 'ins') AS ins,
  count(*) FILTER (cls = 'del') AS del, count(*) FILTER (cls = 'complex') AS complex, count(*) FILTER (cls IN {LOOSE}) AS other FROM x GROUP BY GROUPING SETS ((chrom, ft), (ft)))
SELECT *, {RATIOS} FROM g"""


def zyg(g: str) -> str:
    return f"CASE WHEN {g} LIKE '%.%' THEN 'unknown' WHEN {g} = '0/0' THEN 'hom_ref' WHEN {g} = '1/1' THEN 'hom_alt' ELSE 'het' END"


def gt(s: str) -> str:
    return f"string_split({s}, ':')[1]"


def gq(s: str) -> str:
    return f"TRY_CAST(string_split({s}, ':')[2] AS int)"


HETS = "list_filter([" + ", ".join(f"CASE WHEN {gt(s)} IN ('0/1', '1|0') THEN '{s}' END" for s in SAMPLES) + "], lambda x: x IS NOT NULL)"


#: Flags of the alleles that stay, per record, and what follows from them.
def kept(classes: str) -> str:
    return f"""k AS (SELECT record_id, list(cls IN {classes} ORDER BY aid) AS keep FROM al GROUP BY record_id),
m AS (SELECT v.*, keep, list_filter(range(1, len(keep) + 1), lambda i: keep[i]) AS own, NOT list_contains(keep, false) AS whole FROM variants v JOIN k USING (record_id))"""


ALT = "CASE WHEN whole THEN alt WHEN len(own) = 0 THEN '.' ELSE array_to_string(list_transform(own, lambda i: string_split(alt, ',')[i]), ',') END AS alt"


def info_kept() -> str:
    values = "string_split(string_split(x, '=')[2], ',')"
    left = f"list_filter({values}, lambda y, i: coalesce(keep[i], false))"
    return f"CASE WHEN whole THEN info ELSE array_to_string(list_transform({ENTRIES}, lambda x: CASE WHEN x LIKE 'AC=%' THEN 'AC=' || CASE WHEN len({left}) = 0 THEN '.' ELSE array_to_string({left}, ',') END ELSE x END), ';') END AS info"


def gt_kept(s: str) -> str:
    one = lambda c: f"CASE WHEN {c} = '1' THEN CASE WHEN keep[1] THEN '1' ELSE '.' END ELSE {c} END"
    g = f"({gt(s)})"
    return f"CASE WHEN whole OR {s} = '.' THEN {s} ELSE concat({one(f'substr({g}, 1, 1)')}, substr({g}, 2, 1), {one(f'substr({g}, 3, 1)')}, ':', string_split({s}, ':')[2]) END AS {s}"


def sample_numbers(s: str) -> str:
    """A sample of NUMBERED after alleles were removed: GT anew, AO by allele, AD with the reference, GL gone."""
    part = lambda i: f"string_split({s}, ':')[{i}]"
    one = lambda c: f"CASE WHEN {c} = '1' THEN CASE WHEN keep[1] THEN '1' ELSE '.' END ELSE {c} END"
    own = lambda v, by: f"array_to_string(list_filter(string_split({v}, ','), lambda y, i: {by}), ',')"
    ao = own(part(2), "keep[i]")
    return f"""CASE WHEN whole OR {s} = '.' THEN {s} ELSE concat({one(f"substr({part(1)}, 1, 1)")}, substr({part(1)}, 2, 1), {one(f"substr({part(1)}, 3, 1)")}, ':',
CASE WHEN {ao} = '' THEN '.' ELSE {ao} END, ':', {own(part(3), "i = 1 OR keep[i - 1]")}, ':.') END AS {s}"""


#: Text lines of the call set, and of the intervals.
LINE = "concat_ws(chr(9), chrom, pos::varchar, rsid, ref, alt, qual::int::varchar, flt, info, format, " + ", ".join(SAMPLES) + ")"
CARRIES = "(list_contains(regexp_split_to_array(gt, '[/|]'), (aid + 1)::varchar))"


def by_sample() -> str:
    rows = " UNION ALL ".join(f"SELECT al.*, '{s}' AS sample, {gt(s)} AS gt, {gq(s)} AS gq FROM al" for s in SAMPLES)
    counts = [f"count(*) FILTER (aid = 0 AND z = '{k}') AS {k}" for k in ("unknown", "hom_ref", "het", "hom_alt", "mixed")]
    c = ts()
    for state, z in (("het", "het"), ("hom", "hom_alt")):
        for kind in ("ts", "tv"):
            for who, op in (("known", "<>"), ("novel", "=")):
                counts.append(f"count(*) FILTER ({CARRIES} AND z = '{z}' AND snp_arity = 2 AND {c[kind]} AND rsid {op} '.') AS {who}_{state}_{kind}")
        counts += [f"count(*) FILTER ({CARRIES} AND z = '{z}' AND cls = '{k}') AS {state}_{k}" for k in ("mnp", "ins", "del", "complex")]
    counts += [f"count(*) FILTER ({CARRIES} AND z IN ('het', 'hom_alt') AND snp_arity = 2 AND {c[k]} AND rsid {op} '.') AS {who}_{k}" for k in ("deam", "am") for who, op in (("known", "<>"), ("novel", "="))]
    seen = " + ".join(f"known_{s}_{k}" for s in ("het", "hom") for k in ("ts", "tv"))
    total = lambda k: " + ".join(f"{w}_{s}_{k}" for w in ("known", "novel") for s in ("het", "hom"))
    return f"""{AL}, r AS ({rows}), z AS (SELECT *, {zyg('gt')} AS z FROM r WHERE gq IS NULL OR gq >= 20),
g AS (SELECT sample, {', '.join(counts)} FROM z GROUP BY sample) SELECT *, {div(seen, f"{total('ts')} + {total('tv')}", '100.0')} AS pct_dbsnp, {div(total('ts'), total('tv'))} AS tstv, {div('known_deam + novel_deam', 'known_am + novel_am')} AS deam_am FROM g"""


def spectrum(key: str, name: str) -> str:
    return f"""{AL}, p AS (SELECT *, {key} AS k FROM al WHERE flt = 'PASS' AND snp_arity = 2), g AS (SELECT k AS {name}, {CHANGES} FROM p WHERE k IS NOT NULL GROUP BY k)
SELECT {name}, known_ts, known_tv, novel_ts, novel_tv, {div('known_ts + novel_ts', 'known_tv + novel_tv')} AS tstv FROM g"""


CALLED = "list_filter(flatten([" + ", ".join(f"regexp_split_to_array({gt(s)}, '[/|]')" for s in SAMPLES) + "]), lambda x: x <> '.')"
OWN_CALLED = f"list_filter({CALLED}, lambda x: x = (aid + 1)::varchar)"


def detailed() -> str:
    z = {s: f"CASE WHEN coalesce({gq(s)} >= 10, true) THEN {zyg(gt(s))} END" for s in SAMPLES}
    out = [f"CASE WHEN {ts()['ts']} THEN 'ts' WHEN {ts()['tv']} THEN 'tv' ELSE '?' END AS change"]
    for k in ("hom_ref", "het", "hom_alt"):
        values = "list_filter([" + ", ".join(f"CASE WHEN {z[s]} = '{k}' THEN {gq(s)} END" for s in SAMPLES) + "], lambda x: x IS NOT NULL)"
        n = " + ".join(f"coalesce({z[s]} = '{k}', false)::int" for s in SAMPLES)
        out += [f"{n} AS n_{k}", f"round(list_avg({values}), 6) AS mean_{k}", f"list_min({values}) AS min_{k}", f"list_max({values}) AS max_{k}"]
    out.append(" + ".join(f"coalesce({z[s]} = 'unknown', false)::int" for s in SAMPLES) + " AS n_unknown")
    for k in ("het", "hom_alt"):
        out.append("concat_ws(',', " + ", ".join(f"CASE WHEN {z[s]} = '{k}' THEN '{s}' END" for s in SAMPLES) + f") AS {k}_samples")
    return f"{AL} SELECT record_id, chrom, npos AS pos, {', '.join(out)} FROM al WHERE snp_arity = 2"


EPOS = "npos + greatest(length(nref), length(nalt)) - 1"
EDGES = "ed AS (SELECT chrom, p, sum(d) AS d FROM (SELECT chrom, s::bigint AS p, 1 AS d FROM iv UNION ALL SELECT chrom, e::bigint + 1, -1 FROM iv) GROUP BY chrom, p)"
COVER = f"{IV}, {EDGES}, cv AS (SELECT chrom, p AS s, lead(p) OVER w - 1 AS e, (sum(d) OVER w)::bigint AS depth FROM ed WINDOW w AS (PARTITION BY chrom ORDER BY p))"
SPLIT = """sp AS (SELECT record_id, chrom, aid, unnest(list_filter(range(1, length(nref) + 1), lambda i: substr(nref, i::int, 1) <> substr(nalt, i::int, 1))) AS i, npos, nref, nalt, info FROM al WHERE cls = 'mnp'),
mn AS (SELECT record_id, chrom, aid::int AS aid, (npos + i - 1)::int AS pos, substr(nref, i::int, 1) AS ref, substr(nalt, i::int, 1) AS alt, info || ';FROM_MNP' AS info FROM sp)"""


def annotated(value: str, key: str) -> str:
    return f"""{AB}, o AS (SELECT DISTINCT {key}, {value} AS v FROM b WHERE {value} <> '.'),
f AS (SELECT a.record_id, string_agg(DISTINCT v, ';' ORDER BY v) AS added FROM a JOIN o ON {match('a', 'o', key)} GROUP BY a.record_id)"""


INFO_FAULT = """SELECT record_id, chrom, pos, NULL::varchar AS sample, 'AC' AS field, 'number' AS rule,
concat('Number=A, values: ', len(string_split(regexp_extract(info, 'AC=([^;]*)', 1), ','))) AS message FROM variants WHERE len(string_split(regexp_extract(info, 'AC=([^;]*)', 1), ',')) <> len(string_split(alt, ','))"""
GT_FAULT = " UNION ALL ".join(f"SELECT record_id, chrom, pos, '{s}' AS sample, 'GQ' AS field, 'type' AS rule, 'not of type Character' AS message FROM variants WHERE {s} <> '.' AND length(string_split({s}, ':')[2]) <> 1" for s in SAMPLES)
INFO_WITH = lambda value: f"CASE WHEN added IS NOT NULL THEN info || ';' || {value} ELSE info END AS info"

SQL: dict[str, str] = {
    "scan_variants": f"WITH {V} SELECT * FROM variants",
    "alleles_normalised": f"{AL} SELECT {COLS}, snp_arity FROM al",
    "class_counts": f"{AL} SELECT cls, count(*) AS n FROM al GROUP BY cls",
    "filter_quality": f"WITH {V} SELECT record_id, CASE WHEN qual < 20 THEN array_to_string(list_concat(list_filter({FILTERS}, lambda x: x <> 'PASS'), ['Q20']), ';') WHEN flt = '.' THEN 'PASS' ELSE flt END AS flt FROM variants",
    "filter_mark_pass": f"WITH {V} SELECT record_id, 'PASS' AS flt FROM variants",
    "filter_pass_only": f"WITH {V} SELECT record_id, qual, 'PASS' AS flt FROM variants WHERE qual >= 20 AND flt IN ('.', 'PASS')",
    "filter_strip_info": f"WITH {V} SELECT record_id, info FROM variants WHERE NOT list_contains({ENTRIES}, 'DB')",
    "filter_keep_info": f"WITH {V} SELECT record_id, info FROM variants WHERE list_contains({ENTRIES}, 'DB')",
    "filter_delete_info": f"WITH {V} SELECT record_id, string_split(info, ';')[1] AS info FROM variants",
    "filter_remove_genotypes": f"WITH {V} SELECT record_id, chrom, pos, rsid, ref, alt, flt, info FROM variants",
    "filter_class_snp": f"{AL}, {kept(chr(40) + chr(39) + 'snp' + chr(39) + chr(41))} SELECT record_id, pos, ref, {ALT}, {info_kept()}, {', '.join(map(gt_kept, SAMPLES))} FROM m WHERE len(own) > 0",
    "filter_class_indel": f"{AL}, {kept('(' + repr('ins') + ', ' + repr('del') + ')')} SELECT record_id, {ALT}, {info_kept()} FROM m WHERE len(own) > 0",
    "filter_snp_reanchor": f"{AL} SELECT record_id, chrom, npos AS pos, nref AS ref, string_agg(nalt, ',' ORDER BY aid) AS alt FROM al WHERE cls = 'snp' GROUP BY record_id, chrom, npos, nref",
    "filter_clear_dbsnp": f"WITH {V} SELECT record_id, '.' AS rsid, info FROM variants",
    "filter_find_hets": f"WITH {V} SELECT record_id, CASE WHEN len({HETS}) > 0 THEN info || ';HET=' || array_to_string({HETS}, ',') ELSE info END AS info FROM variants",
    "filter_sample_subset": f"WITH {V} SELECT record_id FROM variants WHERE regexp_matches({gt('S1')}, '[1-9]') OR regexp_matches({gt('S3')}, '[1-9]')",
    "split_mnps": f"{AL}, {SPLIT} SELECT * FROM mn",
    "dedupe_snps": f"""{AL}, {SPLIT}, u AS (SELECT record_id, chrom, aid::int AS aid, npos AS pos, nref AS ref, nalt AS alt, false AS from_mnp FROM al WHERE cls = 'snp'
UNION ALL SELECT record_id, chrom, aid, pos, ref, alt, true FROM mn)
SELECT record_id, chrom, aid, pos, ref, alt, from_mnp FROM u QUALIFY row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY from_mnp, record_id, aid) = 1""",
    "merge_files": f"WITH {CA}, {CB} SELECT 0 AS file_idx, record_id, chrom, pos, ref, alt FROM calls_a UNION ALL SELECT 1, record_id, chrom, pos, ref, alt FROM calls_b",
    "intersect_common_a": f"{AB} SELECT {COLS} FROM a WHERE cls NOT IN {LOOSE} AND EXISTS (SELECT 1 FROM b WHERE {match('a', 'b', KEY)})",
    "intersect_common_b": f"{AB} SELECT {COLS} FROM b WHERE cls NOT IN {LOOSE} AND EXISTS (SELECT 1 FROM a WHERE {match('a', 'b', KEY)})",
    "intersect_sites_only": f"{AB} SELECT {COLS} FROM a WHERE cls NOT IN {LOOSE} AND EXISTS (SELECT 1 FROM b WHERE {match('a', 'b', SITE)})",
    "intersect_pass_only": f"{AB} SELECT {COLS} FROM a WHERE flt = 'PASS' AND cls NOT IN {LOOSE} AND EXISTS (SELECT 1 FROM b WHERE b.flt = 'PASS' AND {match('a', 'b', KEY)})",
    **{
        f"intersect_unique_{x}": f"""{AB} SELECT {COLS} FROM {x} WHERE cls NOT IN {LOOSE} AND NOT EXISTS (SELECT 1 FROM {y} WHERE {match('a', 'b', KEY)})
UNION ALL SELECT {COLS} FROM {x} WHERE cls IN {LOOSE} AND NOT EXISTS (SELECT 1 FROM {y} WHERE {match('a', 'b', 'chrom, npos')})"""
        for x, y in (("a", "b"), ("b", "a"))
    },
    "intersect_union": f"{AB} SELECT {COLS}, 0 AS source FROM a UNION ALL SELECT {COLS}, 1 FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {match('a', 'b', KEY)})",
    "intersect_best_quality": f"""{AB}, u AS (SELECT {KEY}, record_id, qual, 0 AS source FROM a WHERE cls NOT IN {LOOSE} UNION ALL SELECT {KEY}, record_id, qual, 1 FROM b WHERE cls NOT IN {LOOSE}),
h AS (SELECT {KEY} FROM u GROUP BY {KEY} HAVING min(source) = 0 AND max(source) = 1)
SELECT u.* FROM u JOIN h USING ({KEY}) QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY qual DESC, source, record_id) = 1""",
    "annotate_dbsnp": f"{annotated('rsid', KEY)} SELECT record_id, coalesce(added, rsid) AS rsid, {INFO_WITH(repr('dbSNP'))} FROM calls_a LEFT JOIN f USING (record_id)",
    "annotate_dbsnp_sites": f"{annotated('rsid', SITE)} SELECT record_id, coalesce(added, rsid) AS rsid, {INFO_WITH(repr('dbSNP'))} FROM calls_a LEFT JOIN f USING (record_id)",
    "annotate_vcf_filter": f"{annotated('flt', KEY)} SELECT record_id, {INFO_WITH('added')} FROM calls_a LEFT JOIN f USING (record_id)",
    "annotate_bed": f"""{AL}, {IV}, q AS MATERIALIZED (SELECT record_id, chrom, npos, {EPOS} AS epos FROM al), f AS (SELECT q.record_id, string_agg(DISTINCT name, ',' ORDER BY name) AS added FROM q JOIN iv ON q.chrom = iv.chrom AND npos <= e AND epos >= s GROUP BY q.record_id)
SELECT record_id, {INFO_WITH('added')} FROM variants LEFT JOIN f USING (record_id)""",
    "bed_overlap": f"{AL}, {IV}, q AS MATERIALIZED (SELECT *, {EPOS} AS epos FROM al) SELECT {COLS} FROM q WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chrom = q.chrom AND npos <= e AND epos >= s)",
    "bed_within": f"{AL}, {IV}, q AS MATERIALIZED (SELECT *, {EPOS} AS epos FROM al) SELECT {COLS} FROM q WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chrom = q.chrom AND npos >= s AND epos <= e)",
    "bed_unique": f"{AL}, {IV}, q AS MATERIALIZED (SELECT *, {EPOS} AS epos FROM al) SELECT {COLS} FROM q WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.chrom = q.chrom AND npos <= e AND epos >= s)",
    "bed_segments": f"WITH {COVER} SELECT * FROM cv WHERE depth > 0 AND e IS NOT NULL",
    "bed_segments_named": f"""WITH {COVER}, sg AS MATERIALIZED (SELECT * FROM cv WHERE depth > 0 AND e IS NOT NULL)
SELECT sg.chrom, sg.s, sg.e, string_agg(DISTINCT name, ';' ORDER BY name) AS names FROM sg JOIN iv ON iv.chrom = sg.chrom AND iv.s <= sg.s AND iv.e >= sg.e GROUP BY sg.chrom, sg.s, sg.e""",
    "bed_merged": f"""WITH {COVER}, sg AS (SELECT chrom, s, e, CASE WHEN lag(e) OVER (PARTITION BY chrom ORDER BY s) + 1 = s THEN 0 ELSE 1 END AS fresh FROM cv WHERE depth > 0 AND e IS NOT NULL),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY s) AS g FROM sg) SELECT chrom, min(s) AS s, max(e) AS e FROM gr GROUP BY chrom, g""",
    "bed_target_stats": f"WITH {IV} SELECT count(*) AS n, sum(e - s + 1)::bigint AS total, avg(e - s + 1) AS mean FROM iv",
    "bed_distance_hist": f"""WITH {V}, {IV}, u AS (SELECT chrom, s::bigint AS p, 0 AS kind, e::bigint AS e FROM iv UNION ALL SELECT chrom, pos, 1, NULL FROM variants),
w AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY p, kind ROWS UNBOUNDED PRECEDING) AS l, min(CASE WHEN kind = 0 THEN p END) OVER (PARTITION BY chrom ORDER BY p, kind ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM u),
x AS (SELECT chrom, CASE WHEN l >= p THEN 0 WHEN r IS NULL OR p - l < r - p THEN l - p ELSE r - p END AS dist FROM w WHERE kind = 1)
SELECT chrom, dist, count(*) AS n FROM x WHERE dist IS NOT NULL GROUP BY chrom, dist""",
    "stats_by_filter": BY_FILTER,
    "stats_pass_by_contig": f"{BY_FILTER} WHERE ft = 'PASS'",
    "stats_totals_by_filter": f"{BY_FILTER} WHERE chrom = 'total'",
    "stats_mnp_lengths": f"{AL} SELECT length(nalt)::int AS len, count(*) AS n FROM al WHERE flt = 'PASS' AND cls = 'mnp' GROUP BY 1",
    "stats_mnp_split": f"{AL}, {SPLIT} SELECT " + ", ".join(f"count(*) FILTER ({c}) AS novel_{k}" for k, c in ts("ref", "alt").items()) + " FROM mn",
    "stats_indel_lengths": f"""{AL}, g AS (SELECT coalesce(len, -1)::int AS len, count(*) FILTER (cls = 'ins') AS n_ins, count(*) FILTER (cls = 'del') AS n_del
FROM (SELECT *, abs(length(nalt) - length(nref)) AS len FROM al WHERE flt = 'PASS' AND cls IN ('ins', 'del')) GROUP BY ROLLUP (len)) SELECT *, {div('n_ins', 'n_del')} AS ins_del FROM g""",
    "stats_samples": by_sample(),
    "stats_allele_count": spectrum("TRY_CAST(string_split(regexp_extract(info, 'AC=([^;]*)', 1), ',')[(aid + 1)::int] AS int)", "ac"),
    "stats_allele_freq": spectrum(f"round(len({OWN_CALLED}) / nullif(len({CALLED})::double, 0), 2)", "af"),
    "stats_detailed": detailed(),
    "stats_annotations": f"""{AL}, x AS (SELECT *, unnest(list_filter({ENTRIES}, lambda x: NOT contains(x, '='))) AS flag FROM al),
g AS (SELECT flag, count(*) FILTER (snp_arity = 2 AND {ts()['ts']}) AS ts, count(*) FILTER (snp_arity = 2 AND {ts()['tv']}) AS tv FROM x GROUP BY flag) SELECT *, {div('ts', 'tv')} AS tstv FROM g""",
    "validate_info": f"WITH {V} {INFO_FAULT}",
    "validate_genotypes": f"WITH {V} {GT_FAULT}",
    "contig_check": f"""WITH {CA}, {CB}, u AS (SELECT chrom, 1 AS x, 0 AS y FROM calls_a WHERE chrom <> 'chr7' UNION ALL SELECT chrom, 0, 1 FROM calls_b WHERE chrom <> 'chr9')
SELECT chrom, sum(x)::bigint AS n_a, sum(y)::bigint AS n_b, sum(x) > 0 AND sum(y) > 0 AS shared FROM u GROUP BY chrom""",
    "distribution_primary": f"""WITH {V} SELECT regexp_extract(info, 'DP=([^;]*)', 1) AS value, count(*) AS n,
round(sum(CAST(string_split(regexp_extract(info, 'AC=([^;]*)', 1), ',')[1] AS double)) / count(*), 6) AS "mean_AC", 0.0::double AS "mean_XX" FROM variants GROUP BY 1""",
    "distribution_hist": f"""WITH {V}, u AS (SELECT 'DP' AS tag, CAST(regexp_extract(info, 'DP=([^;]*)', 1) AS double) AS value FROM variants
UNION ALL SELECT 'AC', CAST(string_split(regexp_extract(info, 'AC=([^;]*)', 1), ',')[1] AS double) FROM variants UNION ALL SELECT 'QUAL', qual FROM variants)
SELECT tag, value, count(*) AS n FROM u GROUP BY tag, value""",
    "modify_info_number_a": f"{AL}, {kept('(' + repr('snp') + ', ' + repr('mnp') + ')')} SELECT record_id, {ALT}, {info_kept()} FROM m",
    "modify_genotypes": f"{AL}, {kept('(' + repr('snp') + ', ' + repr('mnp') + ')')} SELECT record_id, {', '.join(map(gt_kept, SAMPLES))} FROM m",
    "modify_genotype_numbers": f"""WITH {V.replace(listed(VARIANT), listed(VARIANT | NUMBERED))}, {alleles('variants', 'al')}, {kept('(' + repr('snp') + ', ' + repr('mnp') + ')')}
SELECT record_id, {', '.join(map(sample_numbers, SAMPLES))} FROM m""",
    "read_vcf_text": f"WITH {V} SELECT chrom, pos, rsid, ref, alt, qual, flt, info, format, {', '.join(SAMPLES)} FROM variants",
    "write_vcf_text": f"WITH {V} SELECT record_id, {LINE} AS value FROM variants",
    "read_bed_text": f"WITH {IV} SELECT * FROM iv",
    "validate_records": f"""WITH {V} SELECT record_id, chrom, pos, NULL::varchar AS sample, CASE WHEN rule = 0 THEN 'POS' ELSE 'QUAL' END AS field, 'type' AS rule,
CASE WHEN rule = 0 THEN 'not a whole number' ELSE 'not a number' END AS message FROM (SELECT record_id, chrom, CASE WHEN record_id % 7 = 0 THEN 0 ELSE pos END AS pos, unnest(list_concat(CASE WHEN record_id % 7 = 0 THEN [0] ELSE [] END, CASE WHEN record_id % 11 = 0 THEN [1] ELSE [] END)) AS rule FROM variants)""",
    "validate_intervals": f"WITH {IV} SELECT chrom, s, s - 2 AS e, name FROM iv WHERE s % 5 = 0",
    "validate_structural": f"{AL} SELECT record_id, chrom, npos, aid::int AS aid, allele, cls FROM al WHERE cls IN {LOOSE}",
    "validate_formats": " UNION ALL ".join(
        f"""SELECT record_id, chrom, pos, '{s}' AS sample, x.field, x.rule, x.message FROM (SELECT *, unnest(list_concat(
CASE WHEN {s} <> '.' THEN [{{'field': 'FORMAT', 'rule': 'fields', 'message': 'fields differ from FORMAT'}}] ELSE [] END,
CASE WHEN {s} <> '.' AND record_id % 3 = 0 THEN [{{'field': 'GT', 'rule': 'range', 'message': 'no such allele'}}] ELSE [] END)) AS x FROM v)"""
        for s in SAMPLES[:1]
    ).join((f"WITH {V}, v AS (SELECT * FROM variants) ", " UNION ALL SELECT record_id, chrom, pos, NULL, 'XX', 'undeclared', 'format is not in the header' FROM v")),
    "missing_tags": "SELECT unnest(['MQ', 'ZZ']) AS id",
    "left_align": f"""WITH RECURSIVE {AL.removeprefix('WITH ')},
la(record_id, aid, p, r, a, l) AS (SELECT record_id, aid::int, npos, nref, nalt, concat('ACCA', repeat('TG', (record_id % 7)::int), CASE WHEN nref LIKE 'G%' THEN 'T' ELSE '' END) FROM al WHERE cls NOT IN {LOOSE}
UNION ALL SELECT record_id, aid, CASE WHEN short THEN p - 1 ELSE p END, CASE WHEN short THEN right(l, 1) ELSE '' END || left(r, length(r) - 1), CASE WHEN short THEN right(l, 1) ELSE '' END || left(a, length(a) - 1),
CASE WHEN short THEN left(l, length(l) - 1) ELSE l END FROM (SELECT *, length(r) = 1 OR length(a) = 1 AS short FROM la) x WHERE right(r, 1) = right(a, 1) AND (NOT short OR length(l) > 0))
SELECT record_id, aid, p::int AS npos, r AS nref, a AS nalt FROM la QUALIFY row_number() OVER (PARTITION BY record_id, aid ORDER BY length(l), length(r)) = 1""",
}

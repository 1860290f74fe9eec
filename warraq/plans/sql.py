"""DuckDB SQL for the engine's queries, written independently of the Spark expressions.

DuckDB's levenshtein counts bytes, so texts are re-spelled with one ASCII character for each distinct
character (or common word) of a pair before they are compared.
"""

from __future__ import annotations

from warraq import schema as S
from warraq.functions.normalize import EVALUATOR_DELETE, EVALUATOR_FOLD
from warraq.functions.pytext import DIACRITICS, FOLD_FROM, FOLD_TO, HEH, PUNCTUATION, TA_MARBUTA, TATWEEL
from warraq.operators.stats import POISSON

_SP = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_NUMBER = rf"^[{_SP}]*\p{{Nd}}+[{_SP}]*[\t.)][{_SP}]*"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(map(_q, values))


def _squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{_SP}]+', ' ', 'g'))"


def _translate(t: str, a: str, b: str) -> str:
    return f"translate({t}, {_q(a)}, {_q(b)})"


def _raw(t: str) -> str:
    lines = f"list_transform(regexp_split_to_array(nfc_normalize(coalesce({t}, '')), '{_BREAK}'), lambda x: regexp_replace(x, '{_NUMBER}', ''))"
    return _squeeze(f"array_to_string({lines}, chr(10))")


def _normalized(raw: str) -> str:
    return _squeeze(_translate(_translate(raw, FOLD_FROM, FOLD_TO), PUNCTUATION, " " * len(PUNCTUATION)))


def _no_tashkeel(normalized: str) -> str:
    return _squeeze(f"regexp_replace({normalized}, '[{DIACRITICS}{TATWEEL}]', '', 'g')")


def _marks(raw: str) -> str:
    return f"regexp_replace({raw}, '[^{DIACRITICS}]', '', 'g')"


def _evaluator(t: str) -> str:
    gone = "".join("\\" + c if c in "\\]^-[" else c for c in EVALUATOR_DELETE)
    return _squeeze(_translate(f"regexp_replace(nfc_normalize(coalesce({t}, '')), {_q('[' + gone + ']')}, '', 'g')", *EVALUATOR_FOLD))


_LATEST = """latest AS (SELECT page_id, system, text FROM parallel_corpus WHERE page_id IS NOT NULL AND system IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY page_id, system ORDER BY ingested_at DESC, row_id DESC) = 1)"""
_NORM = f"""{_LATEST},
n1 AS MATERIALIZED (SELECT page_id, system, {_raw('text')} AS raw FROM latest),
n2 AS MATERIALIZED (SELECT *, {_normalized('raw')} AS normalized FROM n1),
norm AS MATERIALIZED (SELECT *, {_no_tashkeel('normalized')} AS no_tashkeel, {_marks('raw')} AS marks FROM n2)"""
_SYSTEMS = _list(S.SYSTEMS)


def _chars(a: str, b: str) -> str:
    """Levenshtein distance of two texts over code points."""
    alpha = f"list_distinct(list_concat(string_split({a}, ''), string_split({b}, '')))"
    spell = lambda t: f"array_to_string(list_transform(string_split({t}, ''), lambda c: chr(list_position(al, c)::INT)), '')"
    return f"(CASE WHEN {a} = {b} THEN 0 WHEN {a} = '' OR {b} = '' THEN greatest(length({a}), length({b})) ELSE (SELECT levenshtein({spell(a)}, {spell(b)}) FROM (SELECT {alpha} AS al)) END)"


def _words(a: str, b: str) -> str:
    """Levenshtein distance of two texts over words; words of one side alone share a character."""
    ws = lambda t: f"list_filter(string_split({t}, ' '), lambda w: w <> '')"
    spell = lambda t, other: f"array_to_string(list_transform({ws(t)}, lambda w: chr(coalesce(2 + nullif(list_position(al, w), 0), {other})::INT)), '')"
    return f"(SELECT levenshtein({spell(a, 1)}, {spell(b, 2)}) FROM (SELECT list_distinct(list_intersect({ws(a)}, {ws(b)})) AS al))"


def _bare(c: str) -> str:
    return f"replace({c}, ' ', '')"


def _pairs(columns: dict[str, str]) -> str:
    """CTE chain ending in ``scored``: per page, system and reference, the given expressions over r.* and h.*"""
    cols = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"""WITH {_NORM},
both_refs AS (SELECT page_id FROM norm WHERE system IN ({_list(S.REFERENCES.values())}) GROUP BY 1 HAVING count(*) = {len(S.REFERENCES)}),
p AS MATERIALIZED (SELECT h.page_id, h.system, CASE r.system WHEN 'gt_muhammad' THEN 'muhammad' ELSE 'hasan' END AS ref,
  r.raw AS r_raw, r.normalized AS r_normalized, r.no_tashkeel AS r_no_tashkeel, r.marks AS r_marks, h.raw AS h_raw, h.normalized AS h_normalized, h.no_tashkeel AS h_no_tashkeel, h.marks AS h_marks
  FROM norm h JOIN both_refs USING (page_id) JOIN norm r ON r.page_id = h.page_id AND r.system IN ({_list(S.REFERENCES.values())}) WHERE h.system IN ({_SYSTEMS})),
one AS MATERIALIZED (SELECT page_id, system, ref, {cols} FROM p),
scored AS MATERIALIZED (SELECT * FROM one UNION ALL SELECT page_id, system, 'best', {', '.join(f'min({k}) AS {k}' for k in columns)} FROM one GROUP BY 1, 2)"""


def _cer(mode: str) -> str:
    a, b = _bare(f"r_{mode}"), _bare(f"h_{mode}")
    return f"{_chars(a, b)} / greatest(length({a}), 1)"


def _wer(mode: str) -> str:
    n = f"len(list_filter(string_split(r_{mode}, ' '), lambda w: w <> ''))"
    return f"{_words(f'r_{mode}', f'h_{mode}')} / greatest({n}, 1)"


_DER = f"CASE WHEN length(r_marks) > 0 THEN {_chars('r_marks', 'h_marks')} / length(r_marks) END"
_ONE = _pairs({"cer_no_tashkeel": _cer("no_tashkeel")})
_BEST = f"{_ONE}, best AS (SELECT page_id, system, cer_no_tashkeel AS v FROM scored WHERE ref = 'best')"
_NUM = "coalesce(try_cast(regexp_extract(page_id, '^page_([0-9]+)$', 1) AS INT), 0)"
_LABEL = "SELECT page_id, min(difficulty) AS difficulty FROM difficulty_labels WHERE difficulty IS NOT NULL GROUP BY 1"
_SUBSET = f"SELECT page_id, CASE WHEN max(repository) = {_q(S.PRIVATE_REPOSITORY)} THEN 'private' ELSE 'public' END AS subset FROM manuscript_provenance GROUP BY 1"


def _bootstrap(rows: str, keys: list[str], metric: str = "v") -> str:
    """CTEs ``ci`` over CTE ``rows`` (keys, u, v): the same hashed draws as the engine's."""
    m = "4294967295"
    k = ", ".join(keys)
    weight = " + ".join(f"(h >= {t})::INT" for t in POISSON if t < 2**32)
    return f"""draws AS (SELECT u, r, (((u::UBIGINT * 2246822519) & {m}) + ((r::UBIGINT * 2654435761) & {m}) + {S.SEED}) & {m} AS h0 FROM (SELECT DISTINCT u FROM {rows}), range(1000) t(r)),
d1 AS (SELECT u, r, (xor(h0, h0 >> 15) * 739982445) & {m} AS h1 FROM draws),
d2 AS (SELECT u, r, (xor(h1, h1 >> 12) * 695872825) & {m} AS h2 FROM d1),
d3 AS (SELECT u, r, xor(h2, h2 >> 15) AS h FROM d2),
w AS MATERIALIZED (SELECT u, r, {weight} AS w FROM d3),
res AS (SELECT {k}, r, sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END) AS mu FROM {rows} JOIN w USING (u) GROUP BY {k}, r),
ci AS (SELECT {k}, quantile_cont(mu, 0.025) AS ci_lo, quantile_cont(mu, 0.975) AS ci_hi FROM res GROUP BY {k}),
mean AS (SELECT {k}, count(*) AS n_pages, count(v) AS n_values, avg(v) AS mean FROM {rows} GROUP BY {k})"""


def _summary(rows: str, keys: list[str], name: str) -> str:
    k = ", ".join(keys)
    return f"{_bootstrap(rows, keys)} SELECT {k}, n_pages, {_q(name)} AS metric, n_values, round(mean, 6) AS mean, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM mean JOIN ci USING ({k})"


def _long(table: str, keys: str, metrics: tuple[str, ...], unit: str = _NUM) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, {_q(m)} AS metric, {unit} AS u, {m} AS v FROM {table}" for m in metrics)


def _summary_long(keys: list[str]) -> str:
    k = ", ".join([*keys, "metric"])
    return f"{_bootstrap('rows', [*keys, 'metric'])} SELECT {k}, n_pages, n_values, round(mean, 6) AS mean, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM mean JOIN ci USING ({k})"


_TWO = ("cer_no_tashkeel", "cer_normalized")
_TWO_PAGES = _pairs({"cer_no_tashkeel": _cer("no_tashkeel"), "cer_normalized": _cer("normalized")})


def _names() -> str:
    """CTE ``names``: candidate file names with their place in line."""
    t = ", ".join(f"({_q(a)}, {_q(t)}, {i})" for a, ts in S.TEMPLATES.items() for i, t in enumerate(ts))
    return f"""tpl(source, tpl, ord) AS (VALUES {t}), pages AS (SELECT DISTINCT n FROM manifest),
forms AS (SELECT n, source, ord, k, nfc_normalize(replace(replace(tpl, '{{n_variants}}', v), '{{n}}', v)) AS name FROM (SELECT *, CASE k WHEN 0 THEN n::VARCHAR WHEN 1 THEN printf('%02d', n) ELSE printf('%03d', n) END AS v FROM pages, tpl, range(3) r(k))),
names AS (SELECT n, source, name, (ord * 10 + row_number() OVER (PARTITION BY n, source, ord ORDER BY min(k)) - 1)::INT AS priority FROM forms GROUP BY n, source, ord, name)"""


_MARK = _q(S.MARKER)
_STRIP = lambda t: f"regexp_replace({t}, '^[{_SP}]+|[{_SP}]+$', '', 'g')"
_TAIL = _STRIP(f"CASE WHEN instr(coalesce(text, ''), {_MARK}) > 0 THEN substr(text, instr(text, {_MARK}) + {len(S.MARKER)}) ELSE '' END")
_HEAD = _STRIP(f"CASE WHEN instr(coalesce(text, ''), {_MARK}) > 0 THEN substr(text, 1, instr(text, {_MARK}) - 1) ELSE coalesce(text, '') END")
_UPPER_HALF = "substr(coalesce(text, ''), (length(coalesce(text, '')) // 2) + 1)"


def _grams(t: str) -> str:
    return f"CASE WHEN length({_bare(t)}) >= 5 THEN list_distinct(list_transform(range(1, length({_bare(t)}) - 3), lambda i: substr({_bare(t)}, i, 5))) ELSE [] END"


_PROBE = f"""WITH {_LATEST},
prov AS (SELECT n, max(repository) AS repository FROM manuscript_provenance WHERE n IS NOT NULL GROUP BY 1),
refs AS (SELECT page_id, try_cast(regexp_extract(page_id, '^page_([0-9]+)$', 1) AS INT) AS n, {_UPPER_HALF} AS bottom FROM latest WHERE system = 'gt_muhammad'),
asked AS (SELECT system, n, {_TAIL} AS prediction FROM (SELECT DISTINCT system, n, text FROM contamination_responses) WHERE n IS NOT NULL),
j AS (SELECT page_id, n, system, CASE WHEN repository = {_q(S.PRIVATE_REPOSITORY)} THEN 'private' ELSE 'public' END AS subset, prediction, bottom,
  {_no_tashkeel(_normalized(_raw('prediction')))} AS a, {_no_tashkeel(_normalized(_raw('bottom')))} AS b FROM asked JOIN refs USING (n) LEFT JOIN prov USING (n)),
g AS (SELECT *, {_grams('a')} AS ga, {_grams('b')} AS gb FROM j),
rows AS (SELECT page_id, n, system, subset, length(prediction)::INT AS prediction_chars, length(bottom)::INT AS gt_bottom_chars,
  CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) ELSE 0.0 END AS jac, upper({_STRIP('prediction')}) = 'UNKNOWN' AS predicted_unknown FROM g)"""

_PAIR_D = f"""{_BEST}, ord AS (SELECT unnest([{_SYSTEMS}]) AS system, unnest(range({len(S.SYSTEMS)})) AS o),
d AS (SELECT oa.system AS system_a, ob.system AS system_b, round(a.v - b.v, 12) AS d FROM best a JOIN ord oa ON oa.system = a.system JOIN best b ON b.page_id = a.page_id JOIN ord ob ON ob.system = b.system WHERE oa.o < ob.o AND a.v IS NOT NULL AND b.v IS NOT NULL),
rk AS (SELECT system_a, system_b, d, rank() OVER (PARTITION BY system_a, system_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY system_a, system_b, abs(d)) - 1) / 2 AS r FROM d)"""

_EXPECTED = (*S.SYSTEMS, *S.REFERENCES.values())

_WORD_COUNT = lambda t: f"len(list_filter(string_split({t}, ' '), lambda w: w <> ''))"
_EVAL = f"""WITH {_LATEST}, t AS MATERIALIZED (SELECT page_id, system, {_evaluator('text')} AS t FROM latest),
ev AS MATERIALIZED (SELECT h.page_id, h.system, CASE r.system WHEN 'gt_muhammad' THEN 'muhammad' ELSE 'hasan' END AS ref, r.t AS r, h.t AS h FROM t h JOIN t r ON r.page_id = h.page_id AND r.system IN ({_list(S.REFERENCES.values())}) WHERE h.system IN ({_SYSTEMS}))"""

ORACLE: dict[str, str] = {
    "q_corpus_long": f"WITH {_LATEST} SELECT page_id, system, coalesce(length(text), 0)::INT AS n_chars, md5(coalesce(text, '')) AS digest FROM latest",
    "q_manifest": f"WITH {_LATEST} SELECT page_id, {', '.join(f'bool_or(system = {_q(s)}) AS has_{s}' for s in S.SYSTEMS)} FROM latest GROUP BY 1",
    "q_coverage": f"WITH {_LATEST}, want AS (SELECT unnest([{_list((*_EXPECTED, 'qalam'))}]) AS system), c AS (SELECT system, count(*) AS n FROM latest GROUP BY 1) SELECT system, coalesce(n, 0)::BIGINT AS pages, round(coalesce(n, 0) / (SELECT greatest(count(DISTINCT page_id), 1) FROM manifest), 6) AS coverage FROM want LEFT JOIN c USING (system)",
    "q_missing": f"WITH {_LATEST}, want AS (SELECT unnest([{_list(_EXPECTED)}]) AS system) SELECT page_id, system FROM (SELECT DISTINCT page_id FROM manifest) m, want WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.page_id = m.page_id AND l.system = want.system)",
    "q_missing_first": f"WITH {_LATEST}, want AS (SELECT unnest([{_list(_EXPECTED)}]) AS system), gone AS (SELECT page_id, system FROM (SELECT DISTINCT page_id FROM manifest) m, want WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.page_id = m.page_id AND l.system = want.system)) SELECT page_id, system, (SELECT count(*) FROM gone) AS missing FROM gone ORDER BY system, page_id LIMIT 20",
    "q_run_plan": "WITH plan AS (SELECT * FROM (SELECT DISTINCT system FROM prompt_ablation_outputs), (SELECT unnest(['v1', 'v2', 'v3']) AS variant), (SELECT DISTINCT n FROM manifest WHERE n IS NOT NULL)) SELECT system, variant, n FROM plan p WHERE NOT EXISTS (SELECT 1 FROM prompt_ablation_outputs o WHERE o.system = p.system AND o.variant = p.variant AND o.n = p.n)",
    "q_norm_raw": f"SELECT row_id, {_raw('text')} AS text FROM parallel_corpus",
    "q_norm_normalized": f"SELECT row_id, {_normalized(_raw('text'))} AS text FROM parallel_corpus",
    "q_norm_no_tashkeel": f"SELECT row_id, {_no_tashkeel(_normalized(_raw('text')))} AS text FROM parallel_corpus",
    "q_norm_tashkeel_only": f"SELECT row_id, {_marks(_raw('text'))} AS text FROM parallel_corpus",
    "q_norm_evaluator": f"SELECT row_id, {_evaluator('text')} AS text FROM parallel_corpus",
    "q_token_counts": f"WITH t AS (SELECT row_id, {_no_tashkeel(_normalized(_raw('text')))} AS t FROM parallel_corpus) SELECT row_id, length({_bare('t')})::INT AS chars, len(list_filter(string_split(t, ' '), lambda w: w <> ''))::INT AS words FROM t",
    "q_response_split": f"SELECT system, n, {_HEAD} AS visible, {_TAIL} AS continuation, upper({_STRIP(_TAIL)}) = 'UNKNOWN' AS predicted_unknown FROM contamination_responses",
    "q_half_split": f"WITH {_LATEST} SELECT page_id, system, {_UPPER_HALF} AS bottom FROM latest",
    "q_subset": f"SELECT page_id, try_cast(regexp_extract(page_id, '^page_([0-9]+)$', 1) AS INT) AS number, CASE WHEN repository = {_q(S.PRIVATE_REPOSITORY)} THEN 'private' ELSE 'public' END AS subset FROM manuscript_provenance",
    "q_flagship": f"{_BEST} SELECT system, count(*) AS n_pages, round(avg(v), 6) AS cer_no_tashkeel_mean FROM best GROUP BY 1",
    "q_cer_pages": _pairs({f"cer_{m}": _cer(m) for m in ("raw", "normalized", "no_tashkeel")}) + " SELECT page_id, system, ref, round(cer_raw, 6) AS cer_raw, round(cer_normalized, 6) AS cer_normalized, round(cer_no_tashkeel, 6) AS cer_no_tashkeel FROM scored",
    "q_wer_pages": _pairs({f"wer_{m}": _wer(m) for m in ("normalized", "no_tashkeel")}) + " SELECT page_id, system, ref, round(wer_normalized, 6) AS wer_normalized, round(wer_no_tashkeel, 6) AS wer_no_tashkeel FROM scored",
    "q_der_pages": _pairs({"der": _DER}) + " SELECT page_id, system, ref, round(der, 6) AS der FROM scored",
    "q_der_bounded": _pairs({"x": f"CASE WHEN greatest(length(r_marks), length(h_marks)) > 0 THEN {_chars('r_marks', 'h_marks')} / greatest(length(r_marks), length(h_marks)) ELSE 0.0 END"}) + " SELECT page_id, system, round(x, 6) AS der_bounded FROM one WHERE ref = 'muhammad'",
    "q_disagreement_zones": f"""WITH {_NORM}, z AS (SELECT m.page_id, m.no_tashkeel AS a, h.no_tashkeel AS b FROM norm m JOIN norm h USING (page_id) WHERE m.system = 'gt_muhammad' AND h.system = 'gt_hasan'),
x AS (SELECT page_id, length(a)::INT AS m_len_no_tashkeel, length(b)::INT AS h_len_no_tashkeel, {_chars('a', 'b')}::INT AS edit_distance_m_h FROM z)
SELECT *, round(edit_distance_m_h / greatest(m_len_no_tashkeel, h_len_no_tashkeel, 1), 6) AS char_disagreement_rate FROM x""",
    "q_char_sdi": f"""{_EVAL}, x AS (SELECT page_id, system, ref, {_bare('r')} AS r, {_bare('h')} AS h FROM ev), y AS (SELECT *, {_chars('r', 'h')} AS errors FROM x)
SELECT page_id, system, ref, errors::INT AS errors, (length(r) - length(h))::INT AS deletions_less_insertions, round(CASE WHEN length(r) > 0 THEN errors / length(r) ELSE 0.0 END, 6) AS cer FROM y""",
    "q_word_errors": f"""{_EVAL}, y AS (SELECT *, {_words('r', 'h')} AS errors, {_WORD_COUNT('r')} AS nr, {_WORD_COUNT('h')} AS nh FROM ev)
SELECT page_id, system, ref, errors::INT AS errors, (nr - nh)::INT AS deletions_less_insertions, round(CASE WHEN nr > 0 THEN errors / nr ELSE 0.0 END, 6) AS wer FROM y""",
    "q_cer_all_rows": f"""WITH {_NORM}, h AS (SELECT row_id, page_id, system, {_no_tashkeel(_normalized(_raw('text')))} AS h FROM parallel_corpus WHERE system IN ({_SYSTEMS}) AND page_id IS NOT NULL),
x AS MATERIALIZED (SELECT h.row_id, h.page_id, h.system, replace(h.h, ' ', '') AS h, replace(m.no_tashkeel, ' ', '') AS m, replace(g.no_tashkeel, ' ', '') AS g FROM h JOIN norm m ON m.page_id = h.page_id AND m.system = 'gt_muhammad' JOIN norm g ON g.page_id = h.page_id AND g.system = 'gt_hasan'),
y AS (SELECT row_id, page_id, system, {_chars('m', 'h')} / greatest(length(m), 1) AS a, {_chars('g', 'h')} / greatest(length(g), 1) AS b FROM x)
SELECT row_id, page_id, system, round(a, 6) AS cer_vs_muhammad, round(b, 6) AS cer_vs_hasan, round(least(a, b), 6) AS cer_best FROM y""",
    "q_typology_totals": _pairs({"e": _chars("r_normalized", "h_normalized")}) + " SELECT system, ref, greatest(sum(e), 1)::BIGINT AS total_edits, sum(e)::BIGINT AS sum_of_classes FROM one GROUP BY 1, 2",
    "q_norm_ta_marbuta": f"SELECT row_id, {_translate(_raw('text'), FOLD_FROM + TA_MARBUTA, FOLD_TO + HEH)} AS text FROM parallel_corpus",
    "q_summary_ci": f"{_ONE}, rows AS (SELECT system, ref, {_NUM} AS u, cer_no_tashkeel AS v FROM scored), " + _summary("rows", ["system", "ref"], "cer_no_tashkeel"),
    "q_subset_means": f"{_ONE}, sub AS ({_SUBSET}), j AS (SELECT * FROM scored LEFT JOIN sub USING (page_id)), g AS (SELECT system, ref, subset, grouping(subset) AS al, count(*) AS n_pages, avg(cer_no_tashkeel) AS mean FROM j GROUP BY GROUPING SETS ((system, ref, subset), (system, ref))) SELECT system, ref, CASE WHEN al = 1 THEN 'all' ELSE subset END AS subset, n_pages, round(mean, 6) AS mean FROM g WHERE al = 1 OR subset IS NOT NULL",
    "q_error_bars": f"{_BEST}, rows AS (SELECT system, {_NUM} AS u, v FROM best), {_bootstrap('rows', ['system'])} SELECT system, round(mean, 6) AS mean, round(mean - ci_lo, 6) AS below, round(ci_hi - mean, 6) AS above FROM mean JOIN ci USING (system)",
    "q_wilcoxon_stat": f"{_PAIR_D} SELECT system_a, system_b, count(*) AS n_pairs, round(avg(d), 6) AS mean_diff, round(least(sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END), sum(CASE WHEN d < 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END)), 6) AS wilcoxon_stat FROM rk GROUP BY 1, 2 HAVING count(*) >= 5",
    "q_heatmap": f"{_BEST} SELECT page_id, {', '.join(f'round(max(v) FILTER (system = {_q(s)}), 6) AS {s}' for s in S.SYSTEMS)} FROM best GROUP BY 1",
    "q_box_stats": f"{_BEST}, q AS (SELECT system, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM best GROUP BY 1) SELECT system, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v), 6) AS whisker_lo, round(max(v), 6) AS whisker_hi FROM q JOIN best USING (system) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL",
    "q_box_by_reference": f"{_ONE}, b AS (SELECT system, ref, cer_no_tashkeel AS v FROM scored WHERE ref <> 'best'), q AS (SELECT system, ref, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1, 2) SELECT system, ref, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v), 6) AS whisker_lo, round(max(v), 6) AS whisker_hi FROM q JOIN b USING (system, ref) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL",
    "q_median_order": f"{_BEST}, m AS (SELECT system, median(v) AS median FROM best GROUP BY 1) SELECT system, round(median, 6) AS median, row_number() OVER (ORDER BY median, system)::INT AS place FROM m",
    "q_difficulty_means": f"{_BEST}, lab AS ({_LABEL}) SELECT system, difficulty, round(avg(v), 6) AS mean FROM best LEFT JOIN lab USING (page_id) GROUP BY 1, 2",
    "q_cost_quality": f"{_BEST}, card AS (SELECT unnest([{_SYSTEMS}]) AS system, unnest([{_list(S.DISPLAY[s] for s in S.SYSTEMS)}]) AS label, unnest([{', '.join(str(S.COST_PER_PAGE[s]) for s in S.SYSTEMS)}])::DOUBLE AS usd_per_page) SELECT label, usd_per_page, round(avg(v), 6) AS mean FROM best JOIN card USING (system) GROUP BY 1, 2",
    "q_iaa_cer": f"""WITH {_NORM}, p AS MATERIALIZED (SELECT r.page_id, r.raw AS r_raw, r.normalized AS r_normalized, r.no_tashkeel AS r_no_tashkeel, r.marks AS r_marks, h.raw AS h_raw, h.normalized AS h_normalized, h.no_tashkeel AS h_no_tashkeel, h.marks AS h_marks FROM norm r JOIN norm h USING (page_id) WHERE r.system = 'gt_muhammad' AND h.system = 'gt_hasan')
SELECT page_id, round({_cer('raw')}, 6) AS cer_raw, round({_cer('normalized')}, 6) AS cer_normalized, round({_cer('no_tashkeel')}, 6) AS cer_no_tashkeel, round({_DER}, 6) AS der FROM p""",
    "q_prompt_ablation": f"""WITH {_NORM}, o AS (SELECT DISTINCT system, variant, n, text FROM prompt_ablation_outputs WHERE text <> '' AND n IS NOT NULL),
x AS MATERIALIZED (SELECT o.system, variant, o.n, {_no_tashkeel(_normalized(_raw('o.text')))} AS h, m.no_tashkeel AS m, g.no_tashkeel AS g FROM o LEFT JOIN norm m ON m.system = 'gt_muhammad' AND try_cast(regexp_extract(m.page_id, '^page_([0-9]+)$', 1) AS INT) = o.n LEFT JOIN norm g ON g.system = 'gt_hasan' AND try_cast(regexp_extract(g.page_id, '^page_([0-9]+)$', 1) AS INT) = o.n),
y AS MATERIALIZED (SELECT system, variant, n, md5(h) AS digest, {_chars(_bare('m'), _bare('h'))} / greatest(length({_bare('m')}), 1) AS a, {_chars(_bare('g'), _bare('h'))} / greatest(length({_bare('g')}), 1) AS b, m IS NULL AS nm, g IS NULL AS ng FROM x)
SELECT system, variant, n, digest, CASE WHEN NOT nm THEN round(a, 6) END AS cer_vs_muhammad, CASE WHEN NOT ng THEN round(b, 6) END AS cer_vs_hasan, round(least(CASE WHEN NOT nm THEN a END, CASE WHEN NOT ng THEN b END), 6) AS cer_best_of_two FROM y""",
    "q_probe_rows": f"{_PROBE} SELECT page_id, n, system, subset, prediction_chars, gt_bottom_chars, round(jac, 6) AS char_5gram_jaccard, predicted_unknown FROM rows",
    "q_probe_summary": f"{_PROBE} SELECT system, subset, count(*) AS n_pages, round(avg(jac), 6) AS mean_jaccard, round(avg(predicted_unknown::INT), 6) AS unknown_rate FROM rows GROUP BY 1, 2",
    "q_ngram_jaccard": f"WITH {_NORM}, g AS (SELECT m.page_id, {_grams('m.no_tashkeel')} AS a, {_grams('h.no_tashkeel')} AS b FROM norm m JOIN norm h USING (page_id) WHERE m.system = 'gt_muhammad' AND h.system = 'gt_hasan') SELECT page_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6) AS jaccard FROM g",
    "q_stratified_pick": f"WITH t AS (SELECT unnest([{_list(S.DIFFICULTY_TARGETS)}]) AS difficulty, unnest([{', '.join(map(str, S.DIFFICULTY_TARGETS.values()))}]) AS target) SELECT page_id, difficulty FROM (SELECT DISTINCT page_id, difficulty FROM difficulty_labels WHERE page_id IS NOT NULL) JOIN t USING (difficulty) QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY md5(page_id || ':{S.SEED}'), page_id) <= target",
    "q_nominal_alpha": f"""WITH {_NORM}, t AS (SELECT page_id, replace(no_tashkeel, ' ', '') AS t FROM norm WHERE system IN ('gt_muhammad', 'gt_hasan', {_q(S.THIRD_ANNOTATOR)})),
l AS (SELECT page_id, t, max(length(t)) OVER (PARTITION BY page_id) AS n, count(*) OVER (PARTITION BY page_id) AS m FROM t),
c AS (SELECT page_id, m, i, CASE WHEN i <= length(t) THEN substr(t, i, 1) ELSE '*' END AS c FROM (SELECT page_id, t, m, unnest(range(1, n + 1)) AS i FROM l WHERE m >= 2 AND n > 0)),
k AS (SELECT page_id, i, c, m, count(*) AS k FROM c GROUP BY ALL),
o AS (SELECT page_id, sum(k * (k - 1) / (m - 1)) AS agree, sum(k) AS n FROM k GROUP BY 1),
e AS (SELECT page_id, sum(k * (k - 1)) AS chance FROM (SELECT page_id, c, sum(k) AS k FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT page_id, round(CASE WHEN n <> chance / (n - 1) THEN 1 - (n - agree) / (n - chance / (n - 1)) END, 6) AS alpha FROM o JOIN e USING (page_id)""",
    "q_file_names": f"WITH {_names()} SELECT n, source, name, priority FROM names",
    "q_resolve_files": f"WITH {_names()}, files AS (SELECT DISTINCT source_path AS path, nfc_normalize(regexp_extract(source_path, '[^/]+$')) AS name FROM parallel_corpus WHERE source_path IS NOT NULL) SELECT n, source, name, path FROM names JOIN files USING (name) QUALIFY row_number() OVER (PARTITION BY n, source ORDER BY priority, path) = 1",
    "q_summary_wide": f"{_TWO_PAGES}, rows AS ({_long('scored', 'system, ref', _TWO)}), {_bootstrap('rows', ['system', 'ref', 'metric'])}, j AS (SELECT * FROM mean JOIN ci USING (system, ref, metric)) SELECT system, ref, max(n_pages) AS n_pages, " + ", ".join(f"round(max(CASE WHEN metric = '{m}' THEN {c} END), 6) AS {m}_{c}" for m in _TWO for c in ("mean", "ci_lo", "ci_hi")) + " FROM j GROUP BY 1, 2",
    "q_revision_stratified": f"{_TWO_PAGES}, sub AS ({_SUBSET}), j AS (SELECT s.*, subset FROM scored s JOIN sub USING (page_id) UNION ALL SELECT *, 'all' FROM scored), rows AS ({_long('j', 'system, ref, subset', _TWO)}), " + _summary_long(["system", "ref", "subset"]),
}
ORACLE["q_annotator_kit"] = f"WITH pick AS ({ORACLE['q_stratified_pick']}), p AS (SELECT page_id, try_cast(regexp_extract(page_id, '^page_([0-9]+)$', 1) AS INT) AS n, difficulty FROM pick) SELECT page_id, n, difficulty, 'image_' || n || '.jpg' AS image_file, 'image_' || n || '.txt' AS template_file, '# Page ' || n || ' (' || difficulty || '). Keep every mark you can see, one line per line.' || chr(10) AS template FROM p"
_ABL = ("cer_vs_muhammad", "cer_vs_hasan", "cer_best_of_two")
ORACLE["q_prompt_ablation_summary"] = f"WITH abl AS ({ORACLE['q_prompt_ablation']}), rows AS ({_long('abl', 'system, variant', _ABL, 'n')}), " + _summary_long(["system", "variant"])


def _clipped(pairs: str, orders: int, units: str, cut: str) -> str:
    """Matches of n-grams per pair and order; ``units`` counts a side's units, ``cut`` takes an n-gram."""
    side = lambda t: f"SELECT id, o, {cut.format(t=t)} AS g, count(*) AS c FROM (SELECT id, {t}, o, unnest(range(1, {units.format(t=t)} - o + 2)) AS i FROM {pairs}, range(1, {orders + 1}) r(o) WHERE {units.format(t=t)} >= o) GROUP BY ALL"
    return f"SELECT x.id, x.o, sum(least(x.c, y.c)) AS m FROM ({side('a')}) x JOIN ({side('b')}) y ON x.id = y.id AND x.o = y.o AND x.g = y.g GROUP BY 1, 2"


# n-gram scores: counts are exploded, clipped per gram and averaged per order
_NGRAM_STEPS = f""",
ids AS MATERIALIZED (SELECT row_number() OVER () AS id, page_id, system, ref, r_no_tashkeel AS r, h_no_tashkeel AS h FROM p),
cs AS MATERIALIZED (SELECT id, replace(r, ' ', '') AS a, replace(h, ' ', '') AS b FROM ids),
ws AS MATERIALIZED (SELECT id, list_filter(string_split(r, ' '), lambda w: w <> '') AS a, list_filter(string_split(h, ' '), lambda w: w <> '') AS b FROM ids),
cm AS MATERIALIZED ({_clipped('cs', 6, 'length({t})', 'substr({t}, i, o)')}),
wm AS MATERIALIZED ({_clipped('ws', 4, 'len({t})', "array_to_string(list_slice({t}, i, i + o - 1), ' ')")}),
co AS (SELECT cs.id, coalesce(m, 0) / (length(b) - r.o + 1) AS pr, coalesce(m, 0) / (length(a) - r.o + 1) AS rc FROM cs, range(1, 7) r(o) LEFT JOIN cm ON cm.id = cs.id AND cm.o = r.o WHERE length(a) >= r.o AND length(b) >= r.o),
cf AS (SELECT id, avg(pr) AS pr, avg(rc) AS rc FROM co GROUP BY 1),
wo AS (SELECT ws.id, r.o, len(a) AS na, len(b) AS nb, coalesce(m, 0) AS m, len(b) - r.o + 1 AS tot FROM ws, range(1, 5) r(o) LEFT JOIN wm ON wm.id = ws.id AND wm.o = r.o WHERE len(b) >= r.o AND len(a) > 0),
wk AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY id ORDER BY o) AS k FROM wo),
wf AS (SELECT id, CASE WHEN max(m) = 0 THEN 0.0 ELSE exp(avg(ln(CASE WHEN m > 0 THEN m / tot ELSE 1 / (pow(2, k) * tot) END))) * CASE WHEN max(nb) >= max(na) THEN 1 ELSE exp(1 - max(na) / max(nb)) END END AS bleu FROM wk GROUP BY 1),
f AS (SELECT page_id, system, ref, CASE WHEN pr + rc > 0 THEN 5 * pr * rc / (4 * pr + rc) ELSE 0.0 END AS chrf, coalesce(bleu, 0.0) AS bleu FROM ids LEFT JOIN cf USING (id) LEFT JOIN wf USING (id)),
fb AS (SELECT * FROM f UNION ALL SELECT page_id, system, 'best', max(chrf), max(bleu) FROM f GROUP BY 1, 2)"""
_NGRAMS = _pairs({"x": "0"}) + _NGRAM_STEPS
_SIX = {f"cer_{m}": _cer(m) for m in ("raw", "normalized", "no_tashkeel")} | {f"wer_{m}": _wer(m) for m in ("normalized", "no_tashkeel")} | {"der": _DER}
_ALL = _pairs(_SIX) + _NGRAM_STEPS + ", al AS MATERIALIZED (SELECT s.*, chrf AS chrf_no_tashkeel, bleu AS bleu_no_tashkeel FROM scored s JOIN fb USING (page_id, system, ref))"
ORACLE["q_per_page_metrics"] = f"{_ALL} SELECT page_id, system, ref, {', '.join(f'round({m}, 6) AS {m}' for m in S.METRICS)} FROM al"
ORACLE["q_summary_per_system"] = f"{_ALL}, rows AS ({_long('al', 'system, ref', S.METRICS)}), " + _summary_long(["system", "ref"])
ORACLE["q_chrf_bleu"] = f"{_NGRAMS} SELECT page_id, system, ref, round(chrf, 6) AS chrf_no_tashkeel, round(bleu, 6) AS bleu_no_tashkeel FROM fb"
ORACLE["q_chrf_against_bleu"] = f"{_NGRAMS} SELECT system, page_id, round(chrf, 6) AS chrf_no_tashkeel, round(bleu, 6) AS bleu_no_tashkeel FROM fb WHERE ref = 'best'"
ORACLE["q_summary_difficulty"] = f"{_ALL}, lab AS ({_LABEL}), j AS (SELECT * FROM al JOIN lab USING (page_id)), rows AS ({_long('j', 'system, ref, difficulty', S.METRICS)}), " + _summary_long(["system", "ref", "difficulty"])
_OUT = _list(S.OUTLIER_PAGES)
ORACLE["q_outlier_sensitivity"] = (
    _pairs({"cer_no_tashkeel": _cer("no_tashkeel"), "cer_normalized": _cer("normalized"), "wer_no_tashkeel": _wer("no_tashkeel")})
    + f", b AS (SELECT * FROM scored WHERE ref = 'best'), j AS (SELECT *, 'all' AS pages FROM b UNION ALL SELECT *, 'excl' FROM b WHERE page_id NOT IN ({_OUT})), rows AS ({_long('j', 'system, pages', S.OUTLIER_METRICS)}), "
    + _bootstrap("rows", ["system", "pages", "metric"])
    + ", s AS (SELECT * FROM mean JOIN ci USING (system, pages, metric)) SELECT x.system, x.metric, x.n_pages, round(x.mean, 6) AS mean_excl, round(x.ci_lo, 6) AS ci_lo_excl, round(x.ci_hi, 6) AS ci_hi_excl, round(x.mean - y.mean, 6) AS delta FROM s x JOIN s y ON x.system = y.system AND x.metric = y.metric WHERE x.pages = 'excl' AND y.pages = 'all'"
)
# the second annotator as hypothesis against the first
_IAA = f"""WITH {_NORM}, p AS MATERIALIZED (SELECT r.page_id, 'gt_hasan' AS system, 'muhammad' AS ref, r.raw AS r_raw, r.normalized AS r_normalized, r.no_tashkeel AS r_no_tashkeel, r.marks AS r_marks, h.raw AS h_raw, h.normalized AS h_normalized, h.no_tashkeel AS h_no_tashkeel, h.marks AS h_marks FROM norm r JOIN norm h USING (page_id) WHERE r.system = 'gt_muhammad' AND h.system = 'gt_hasan'),
scored AS MATERIALIZED (SELECT page_id, system, ref, {', '.join(f'{v} AS {k}' for k, v in _SIX.items())} FROM p)"""
_IAA_ALL = _IAA + _NGRAM_STEPS + ", al AS MATERIALIZED (SELECT s.*, chrf AS chrf_no_tashkeel, bleu AS bleu_no_tashkeel FROM scored s JOIN f USING (page_id, system, ref))"
ORACLE["q_iaa_per_page"] = f"{_IAA_ALL} SELECT page_id, {', '.join(f'round({m}, 6) AS {m}' for m in S.METRICS)} FROM al"
ORACLE["q_iaa_summary"] = (
    f"{_IAA_ALL}, c AS (SELECT *, 'hasan_vs_muhammad' AS comparison FROM al), rows AS ({_long('c', 'comparison', S.METRICS)}), {_bootstrap('rows', ['comparison', 'metric'])}, j AS (SELECT * FROM mean JOIN ci USING (comparison, metric)) SELECT comparison, max(n_pages) AS n_pages, "
    + ", ".join(f"round(max(CASE WHEN metric = '{m}' THEN {c} END), 6) AS {m}_{c}" for m in S.METRICS for c in ("mean", "ci_lo", "ci_hi"))
    + " FROM j GROUP BY 1"
)
ORACLE["q_iaa_by_difficulty"] = f"{_IAA}, lab AS ({_LABEL}) SELECT difficulty, count(*) AS n_pages, round(avg(cer_no_tashkeel), 6) AS mean FROM scored LEFT JOIN lab USING (page_id) GROUP BY 1"
ORACLE["q_ranking"] = _pairs({"cer_no_tashkeel": _cer("no_tashkeel"), "wer_no_tashkeel": _wer("no_tashkeel")}) + ", m AS (SELECT system, count(*) AS n_pages, avg(cer_no_tashkeel) AS c, avg(wer_no_tashkeel) AS w FROM scored WHERE ref = 'best' GROUP BY 1) SELECT system, n_pages, round(c, 6) AS cer_mean, round(w, 6) AS wer_mean, row_number() OVER (ORDER BY c, system)::INT AS place FROM m"
_BOX = {m: _cer(m.split("_", 1)[1]) if m.startswith("cer") else _DER for m in S.BOX_METRICS}
ORACLE["q_box_metrics"] = (
    _pairs(_BOX)
    + ", b AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, system, {m} AS v FROM scored WHERE ref = 'best' AND {m} IS NOT NULL" for m in S.BOX_METRICS) + "), q AS (SELECT metric, system, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1, 2),"
    + f" i AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _BOX.items())} FROM (SELECT r.page_id, r.normalized AS r_normalized, r.no_tashkeel AS r_no_tashkeel, r.marks AS r_marks, h.normalized AS h_normalized, h.no_tashkeel AS h_no_tashkeel, h.marks AS h_marks FROM norm r JOIN norm h USING (page_id) WHERE r.system = 'gt_muhammad' AND h.system = 'gt_hasan')),"
    + " il AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, avg({m}) AS iaa_mean FROM i" for m in S.BOX_METRICS) + ") SELECT metric, system, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v), 6) AS whisker_lo, round(max(v), 6) AS whisker_hi, round(max(iaa_mean), 6) AS iaa_mean FROM q JOIN b USING (metric, system) LEFT JOIN il USING (metric) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY metric, system, q1, median, q3"
)
# p-values by the normal approximation (groups here have more than 50 pairs); the complementary error function from the series of erf
_ERFC = "CASE WHEN z > 6 THEN 0.0 WHEN z = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 200), lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln(z) + lgamma(k + 1) - lgamma(2 * k + 2)))) END"
ORACLE["q_wilcoxon"] = f"""{_PAIR_D}, t AS (SELECT system_a, system_b, sum(c * c * c - c) AS ties FROM (SELECT system_a, system_b, abs(d) AS s, count(*)::DOUBLE AS c FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2),
w AS (SELECT system_a, system_b, count(*)::DOUBLE AS n, avg(d) AS mean_diff, least(sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END), sum(CASE WHEN d < 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0 END)) AS stat FROM rk GROUP BY 1, 2 HAVING count(*) >= 5),
v AS (SELECT *, n * (n + 1) * (2 * n + 1) / 24 - ties / 48 AS var FROM w JOIN t USING (system_a, system_b)),
z AS (SELECT *, CASE WHEN var > 0 THEN abs(stat - n * (n + 1) / 4) / sqrt(var) / sqrt(2) ELSE 0 END AS z FROM v),
pv AS (SELECT z.*, oa.o * 100 + ob.o AS o, {_ERFC} AS p FROM z JOIN ord oa ON oa.system = system_a JOIN ord ob ON ob.system = system_b)
SELECT system_a, system_b, n::BIGINT AS n_pairs, round(mean_diff, 6) AS mean_diff, round(stat, 6) AS wilcoxon_stat, round(p, 6) AS p_value, round(least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, o) + 1)), 6) AS p_holm FROM pv"""
_THREE = f"""WITH {_NORM}, tri AS MATERIALIZED (SELECT a.page_id, {', '.join(f"{_bare(f'{x}.{m}')} AS {x}_{m}" for x in 'abc' for m in ('no_tashkeel', 'normalized'))} FROM norm a JOIN norm b USING (page_id) JOIN norm c USING (page_id) WHERE a.system = 'gt_muhammad' AND b.system = 'gt_hasan' AND c.system = {_q(S.THIRD_ANNOTATOR)}),
thr AS MATERIALIZED (SELECT page_id, {', '.join(f"{_chars(f'{x}_{m}', f'{y}_{m}')} / greatest(length({x}_{m}), 1) AS cer_A{i}_A{j}{end}" for end, m in (('', 'no_tashkeel'), ('_norm', 'normalized')) for i, j, x, y in ((1, 2, 'a', 'b'), (1, 3, 'a', 'c'), (2, 3, 'b', 'c')))} FROM tri)"""
_THREE_NAMES = [f"cer_A{i}_A{j}{end}" for end in ("", "_norm") for i, j in ((1, 2), (1, 3), (2, 3))]
ORACLE["q_third_annotator"] = f"{_THREE} SELECT page_id, {', '.join(f'round({c}, 6) AS {c}' for c in _THREE_NAMES)} FROM thr"
ORACLE["q_third_annotator_means"] = f"{_THREE} SELECT count(*) AS pages, {', '.join(f'round(avg(round({c}, 6)), 6) AS {c}_mean' for c in _THREE_NAMES)} FROM thr"
_BOUNDED = f"CASE WHEN greatest(length(r_marks), length(h_marks)) > 0 THEN {_chars('r_marks', 'h_marks')} / greatest(length(r_marks), length(h_marks)) ELSE 0.0 END"
ORACLE["q_der_bounded_summary"] = f"""WITH {_NORM}, both_refs AS (SELECT page_id FROM norm WHERE system IN ({_list(S.REFERENCES.values())}) GROUP BY 1 HAVING count(*) = 2),
p AS MATERIALIZED (SELECT h.page_id, h.system, r.marks AS r_marks, h.marks AS h_marks FROM norm h JOIN both_refs USING (page_id) JOIN norm r ON r.page_id = h.page_id AND r.system = 'gt_muhammad' WHERE h.system IN ({_SYSTEMS}, 'gt_hasan')),
rows AS (SELECT system, {_NUM} AS u, {_BOUNDED} AS v FROM p), """ + _summary("rows", ["system"], "der_bounded")

"""The queries of the core once more, as SQL for an independent engine on the same tables."""

from __future__ import annotations

import re

from scriptorium.functions import patterns as P
from scriptorium.operators.features import OTHER_DIGITS
from scriptorium.operators.variants import TEMPLATES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{P.WS}+|{P.WS}+$')}, '', 'g')"


def m(x: str, *ps: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in ps) + ")"


def cnt(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {q(p)}))"


def sub(x: str, w: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(w)}, ''))) // {len(w)})"


def subs(x: str, ws: tuple[str, ...]) -> str:
    return "(" + " + ".join(sub(x, w) for w in ws) + ")"


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def rep(x: str, p: str, r: str) -> str:
    return f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"


DOCS = "docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text FROM documents)"
PARAS = "paras AS (SELECT *, coalesce(text, '') AS t FROM paragraphs)"
FURNITURE = f"({m(strip('l'), *P.FURNITURE)} OR ({m(strip('l'), P.PAGE_NUMBER)} AND length({strip('l')}) < {P.PAGE_NUMBER_BELOW}))"
CL1 = f"array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT {FURNITURE}), chr(10))"
CL2B = rep(rep("text", rf"({P.HAN}){P.WS}+([a-zA-Z0-9])", r"\1\2"), rf"([a-zA-Z0-9]){P.WS}+({P.HAN})", r"\1\2")
CL3 = rep(f"replace({rep(rep('replace(text, ' + q('&#x27;') + ', chr(39))', '&[a-zA-Z]+;', ''), P.CONTROL, '')}, {q(chr(0xFFFD))}, '')", P.DOUBLED_END, r"\1")
CL4 = "regexp_replace(replace(replace(regexp_replace(text, ' {2,}', ' ', 'g'), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')"
CHINESE = div(cnt("text", P.HAN), f"length({strip('text')})")
GARBLED = f"CASE WHEN length(text) > 0 THEN 1 - CAST({cnt('text', '[' + P.VALID + ']')} AS DOUBLE) / length(text) ELSE CAST(0 AS DOUBLE) END"
CHAPTERS = m("text", P.CHAPTER_ANYWHERE, *P.CHAPTER_LINE)
ENDING = "(" + " OR ".join(f"contains(text, {q(e)})" for e in P.ENDINGS) + ")"
DIRTY = m("text", *P.DIRTY)
HEADER = lambda x: m(x, *P.HEADER)
DROPPED = lambda x: m(x, *("(?i)" + p for p in P.DROPPED))


def para_type(x: str) -> str:
    s = strip(x)
    W, D, N = P.WS, P.DIGIT, P.NWS
    return f"""CASE WHEN {m(s, f'^摘要{W}*$', f'(?i)^ABSTRACT{W}*$')} THEN 'abstract'
 WHEN {m(s, f'^表{W}*(?:{D}|-)+(?:[.、]|{W})', f'^表{W}*{D}+{W}+[^。]{{1,30}}$')} THEN 'table_note'
 WHEN {m(s, f'^图{W}*(?:{D}|-)+(?:[.、]|{W})', f'^图{W}*{D}+{W}+[^。]{{1,30}}$')} THEN 'figure_note'
 WHEN {m(s, f'^公式{W}*(?:{D}|[(' + chr(92) + '[])', f'^式{W}*[(' + chr(92) + f'[]{W}*{D}+')} OR ({m(s, rf'^\({W}*{D}+{W}*\)')} AND length({s}) < 50) THEN 'formula_note'
 WHEN {m(s, f'^{D}+、{W}', rf'^\({D}+\){W}')} THEN 'list_like'
 WHEN {m(s, rf'^{D}+\.{W}+{N}')} THEN CASE WHEN length({s}) > 40 THEN 'list_like' ELSE 'heading' END
 WHEN {m(s, '^[①②③④⑤⑥⑦⑧⑨⑩]', '^[•·◆◇○●]')} THEN 'list_like' ELSE 'normal' END"""


def role(x: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({x}), {q(w)})" for w in ws) + f" THEN '{r}'" for r, ws in P.ROLES.items()) + " ELSE 'other' END"


FORMULA = lambda x: f"({m(x, P.FORMULA)} OR contains({x}, '公式'))"
SENTENCES = lambda x: f"len(list_filter(string_split_regex({x}, {q(P.SENTENCE_END)}), lambda s: {strip('s')} <> ''))"
CHECK = f"""chk AS (SELECT doc_id, length(text) AS char_count, {CHINESE} AS chinese_ratio, {GARBLED} AS garbled_ratio, {CHAPTERS} AS has_chapter_structure, {ENDING} AS has_valid_ending, {DIRTY} AS dirty FROM docs),
rep AS (SELECT *, list_filter([CASE WHEN garbled_ratio > {P.MAX_GARBLED} THEN '乱码比例 ' || printf('%.2f%%', garbled_ratio * 100) END, CASE WHEN chinese_ratio < {P.MIN_CHINESE} THEN '中文比例 ' || printf('%.2f%%', chinese_ratio * 100) END,
 CASE WHEN char_count < {P.MIN_CHARS} THEN '字数 ' || char_count END, CASE WHEN NOT has_chapter_structure THEN '缺少章节结构' END, CASE WHEN NOT has_valid_ending THEN '缺少参考文献/致谢/附录' END], lambda x: x IS NOT NULL) AS issues,
 (dirty OR garbled_ratio > {P.ERROR_GARBLED}) AS needs_model_fix,
 CASE WHEN garbled_ratio > {P.ERROR_GARBLED} THEN 'error' WHEN garbled_ratio > {P.MAX_GARBLED} OR chinese_ratio < {P.MIN_CHINESE} OR char_count < {P.MIN_CHARS} OR NOT has_chapter_structure OR NOT has_valid_ending THEN 'warning' ELSE 'passed' END AS status FROM chk)"""
#: A mark put after every character that is no word character, so that each can close one run of letters and open the next.
MARK = chr(0xE000)
RUN = rf"(?:^|{MARK})[A-Za-z](?:{P.WS}{MARK}[A-Za-z]){{3,}}(?:[^\pL\pN_{MARK}]|$)"


def spaced(source: str, name: str, out: str) -> str:
    """CTEs that merge spaced letters of `text`: runs and what stands between them are taken apart, put together again, and the marks removed."""
    x = rep("text", r"([^\pL\pN_])", rf"\1{MARK}")
    joined = f"array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce(regexp_replace(ms[i], {q(P.WS + MARK)}, '', 'g'), '')), '')"
    return f"{name}0 AS (SELECT *, {x} AS x FROM {source}), {name}1 AS (SELECT *, string_split_regex(x, {q(RUN)}) AS ps, regexp_extract_all(x, {q(RUN)}) AS ms FROM {name}0), {name} AS (SELECT * EXCLUDE (x, ps, ms), replace({joined}, {q(MARK)}, '') AS {out} FROM {name}1)"


def on(c: str, expr: str) -> str:
    """An expression on `text`, on another column."""
    return re.sub(r"\btext\b", c, expr)


CLEAN = f"""a0 AS (SELECT doc_id, text IS NULL AS unread, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS t0 FROM documents), a1 AS (SELECT *, {on('t0', CL1)} AS text FROM a0), {spaced('a1', 'a2', 't2')},
a3 AS (SELECT *, {on('t2', CL2B)} AS t3 FROM a2), a4 AS (SELECT *, {on('t3', CL3)} AS t4 FROM a3), a5 AS (SELECT *, {on('t4', CL4)} AS t5 FROM a4),
cleaned AS (SELECT doc_id, unread, t5 AS text, list_filter([CASE WHEN text <> t0 THEN '页眉页脚删除' END, CASE WHEN t2 <> text THEN '字母间距修复' END, CASE WHEN t4 <> t3 THEN '乱码清理' END, CASE WHEN t5 <> t4 THEN '多余空格清理' END], lambda x: x IS NOT NULL) AS fixes FROM a5)"""
SEGMENT = f"""ls AS (SELECT doc_id, pos, {strip('raw')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs)),
h AS (SELECT *, {HEADER('line')} AS header, line = '' AS blank FROM ls),
g AS (SELECT *, sum(CASE WHEN header OR blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM h),
u0 AS (SELECT doc_id, g, header, min(pos) AS pos, string_agg(line, ' ' ORDER BY pos) AS text FROM g WHERE NOT blank GROUP BY doc_id, g, header),
u1 AS (SELECT * FROM u0 WHERE header OR NOT {DROPPED('text')}),
u2 AS (SELECT *, last_value(CASE WHEN header THEN {strip("regexp_replace(text, '^#+', '')")} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ch, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM u1),
u3 AS (SELECT *, coalesce(ch, '{P.UNKNOWN_CHAPTER}') AS chapter, sum(CASE WHEN header OR length(text) >= {P.SHORT_BODY} OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS para_index FROM u2),
u4 AS (SELECT doc_id, para_index, string_agg(text, ' ' ORDER BY pos) AS text, arg_min(text, pos) AS own, arg_min(chapter, pos) AS chapter, arg_min(header, pos) AS header FROM u3 GROUP BY doc_id, para_index),
seg AS (SELECT doc_id, CAST(para_index AS INT) AS para_index, text, chapter, CASE WHEN header THEN 'heading' ELSE {para_type('own')} END AS para_type, CASE WHEN chapter = '{P.UNKNOWN_CHAPTER}' THEN 'other' ELSE {role('chapter')} END AS chapter_role,
 CAST(length(text) AS INT) AS char_count, CAST(CASE WHEN header THEN length(own) ELSE {cnt('own', P.HAN)} END AS INT) AS word_count, CAST(CASE WHEN header THEN 0 ELSE {SENTENCES('own')} END AS INT) AS sentence_count,
 NOT header AND {m('own', P.CITATION)} AS has_citation, NOT header AND {FORMULA('own')} AS has_formula, NOT header AND {m('own', P.TABLE_REF)} AS has_table_ref, NOT header AND {m('own', P.FIGURE_REF)} AS has_figure_ref FROM u4)"""


def first(patterns: tuple[str, ...], passes: str, tidy: bool) -> str:
    ex = ", ".join(strip(f"regexp_extract(l, {q(p)}, 1)") if tidy else f"regexp_extract(l, {q(p)}, 1)" for p in patterns)
    return f"coalesce(list_filter(flatten(list_transform(string_split(text, chr(10))[1:100], lambda l: [{ex}])), lambda x: {passes})[1], '')"


TITLE = f"coalesce(list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10))[1:50], lambda l: {strip('l')}), lambda l: starts_with(l, '# ')), lambda l: {strip('substr(l, 3)')}), lambda x: length(x) > 5 AND length(x) < 100)[1], '')"
SCHOOL = first(P.SCHOOL, "length(x) > 4 AND NOT contains(x, '专业') AND NOT contains(x, '班级')", False)
MAJOR = first(P.MAJOR, "x <> ''", True)
AUTHOR = first(P.AUTHOR, "length(x) BETWEEN 2 AND 10", True)
CHAPTER_COUNT = f"len(list_filter(string_split(text, chr(10)), lambda l: {m(strip('l'), P.CHAPTER_HEAD)}))"
PATH = "source_path"
FOLDER = lambda up: f"coalesce(list_reverse(string_split({PATH}, '/'))[{up + 1}], '')"
YEARISH = lambda x: f"CASE WHEN regexp_matches({x}, '^[0-9]{{4}}$') AND CAST(CASE WHEN regexp_matches({x}, '^[0-9]{{4}}$') THEN {x} END AS INT) BETWEEN 2000 AND 2030 THEN CAST(CASE WHEN regexp_matches({x}, '^[0-9]{{4}}$') THEN {x} END AS INT) END"
STEM = f"regexp_extract({PATH}, '([^/]+?)(?:\\.[^./]*)?$', 1)"
YEAR_PATH = f"coalesce({YEARISH(FOLDER(2))}, {YEARISH(FOLDER(1))}, CAST(nullif(regexp_extract({STEM}, '(20[0-9]{{2}})', 1), '') AS INT), 0)"
SPLIT_OF = lambda y: "CASE " + " ".join(f"WHEN {y} BETWEEN {lo} AND {hi} THEN '{k}'" for k, (lo, hi) in P.YEARS.items()) + " END"
SCORE = "(CASE WHEN char_count BETWEEN 50 AND 300 THEN 2.0 ELSE 0 END + CASE WHEN has_citation THEN 1.5 ELSE 0 END + CASE WHEN has_formula THEN 1.0 ELSE 0 END + CASE WHEN chapter_role IN ('methodology', 'discussion', 'findings') THEN 2.0 ELSE 0 END + CASE WHEN para_type = 'normal' THEN 1.0 ELSE 0 END)"
HARD = f"""s AS (SELECT row_id, doc_id, split, CAST({SCORE} AS DOUBLE) AS score FROM paragraphs WHERE split IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, row_id) <= floor(count(*) OVER (PARTITION BY split) * CAST({P.HARD_RATIO} AS DOUBLE)) AS cand FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY split, doc_id, cand ORDER BY score DESC, row_id) AS dn, count(*) OVER (PARTITION BY split, doc_id, cand) AS dc FROM k),
hard AS (SELECT row_id, doc_id, split, score, cand AND (dn - 1) < dc * 0.5 AS hard FROM n)"""
DOCSPLIT = f"ds AS (SELECT DISTINCT doc_id, year, {SPLIT_OF('year')} AS split FROM documents_metadata WHERE year > 0 AND coalesce(doc_id, '') <> '' AND {SPLIT_OF('year')} IS NOT NULL)"
FIXED = f"""my AS (SELECT doc_id, max(year) AS my FROM documents_metadata WHERE year > 0 GROUP BY doc_id),
fixed AS (SELECT v.*, CASE WHEN v.year = 0 AND my IS NOT NULL THEN my ELSE v.year END AS y, v.year = 0 AND my IS NOT NULL AS updated FROM variants v LEFT JOIN my USING (doc_id)),
mis AS (SELECT *, {SPLIT_OF('y')} AS target_split, coalesce({SPLIT_OF('y')} <> split, false) AS misplaced, substr(original_text, 1, 50) AS key FROM fixed)"""
N = "length(t)"
ONLINE_S = f"list_filter(list_transform(string_split_regex(t, '[。！？.\\n]'), lambda s: {strip('s')}), lambda s: s <> '')"
TRAIN_S = f"list_filter(string_split_regex(t, {q(P.SENTENCE_END)}), lambda s: {strip('s')} <> '')"
HANS = f"regexp_extract_all(t, {q(P.HAN)})"
VERR = """CASE WHEN variant_text IS NULL OR variant_text = '' OR doc_id IS NULL OR doc_id = '' OR year IS NULL OR para_type IS NULL OR para_type = '' OR chapter_role IS NULL OR chapter_role = '' OR variant_type IS NULL OR variant_type = '' THEN 'missing ' || array_to_string(list_filter([CASE WHEN coalesce(variant_text, '') = '' THEN 'variant_text' END, CASE WHEN coalesce(doc_id, '') = '' THEN 'doc_id' END, CASE WHEN year IS NULL THEN 'year' END, CASE WHEN coalesce(para_type, '') = '' THEN 'para_type' END, CASE WHEN coalesce(chapter_role, '') = '' THEN 'chapter_role' END, CASE WHEN coalesce(variant_type, '') = '' THEN 'variant_type' END], lambda x: x IS NOT NULL), ',') WHEN year = 0 THEN 'year=0' WHEN length(variant_text) < 50 THEN 'short ' || length(variant_text) END"""
HUMAN = "SELECT text, doc_id, para_index, year, para_type, chapter_role, 0 AS label, CASE WHEN ends_with(split, '_hard') THEN 'hard' ELSE 'standard' END AS difficulty_level, 'human' AS generation_path, split FROM paragraphs WHERE length(text) BETWEEN 50 AND 500"
AIROWS = f"SELECT variant_text AS text, doc_id, -1 AS para_index, year, para_type, chapter_role, 1 AS label, CASE WHEN variant_type = 'hard_human' THEN 'hard' ELSE 'standard' END AS difficulty_level, variant_type AS generation_path, split FROM variants WHERE ({VERR}) IS NULL"
PROBS = "probs AS (SELECT row_id, doc_id, para_index, " + ", ".join(f"((row_id * {a} + para_index * {b}) % 101) / CAST(100 AS DOUBLE) AS {k}" for k, a, b in zip(P.MODELS, (37, 53, 71, 29, 83), (11, 7, 13, 17, 19))) + " FROM paragraphs)"
K = lambda ts: "CASE " + " ".join(f"WHEN {k} > {t} THEN {i}" for i, (k, t) in enumerate(zip(P.MODELS, ts), 1)) + " END"
ALL = "[" + ", ".join(P.MODELS) + "]"
NAMES = "[" + ", ".join(f"'{k}'" for k in P.MODELS) + "]"
FUSED = f"f0 AS (SELECT *, {K([0.35] * 5)} AS k, greatest({', '.join(P.MODELS)}) AS max_prob FROM probs), fused AS (SELECT row_id, doc_id, para_index, k, max_prob, k IS NOT NULL AS is_ai, CASE WHEN k IS NULL THEN max_prob ELSE {ALL}[k] END AS confidence, CASE WHEN k IS NULL THEN 'none' ELSE {NAMES}[k] END AS triggered_by FROM f0)"
CAL = f"c0 AS (SELECT *, {K([P.CALIBRATED[k] for k in P.MODELS])} AS k, list_position({ALL}, list_max({ALL})) AS b FROM probs), cal AS (SELECT row_id, doc_id, k IS NOT NULL OR {ALL}[coalesce(k, b)] > 0.5 AS is_ai, {ALL}[coalesce(k, b)] AS raw_probability, {ALL}[coalesce(k, b)] * CAST({P.CALIBRATION} AS DOUBLE) AS calibrated_score, {NAMES}[coalesce(k, b)] AS triggered_by FROM c0)"
RISK = "CASE WHEN confidence > 0.5 THEN 'high' WHEN confidence > 0.35 THEN 'medium' ELSE 'low' END"
DOC_RISK = "CASE " + " ".join(f"WHEN s < {c} THEN '{n}'" for c, n in P.RISKS) + f" ELSE '{P.HIGHEST_RISK}' END"
CALDOC = f"cd AS (SELECT doc_id, avg(calibrated_score) AS a, round(avg(calibrated_score), 12) AS s, count(*) FILTER (is_ai) AS ai_paragraph_count, count(*) AS total_paragraphs FROM cal GROUP BY doc_id)"
SCORED = "sc AS (SELECT model, split, CASE WHEN row_id % 2 = 0 THEN 'hard' ELSE 'standard' END AS difficulty, CASE WHEN row_id % 3 = 0 THEN 1 ELSE 0 END AS y, p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred FROM (SELECT *, ((CASE WHEN row_id % 3 = 0 THEN 30 ELSE 0 END) + (row_id * CASE model WHEN 'gbdt' THEN 37 WHEN 'rf' THEN 53 ELSE 29 END) % 71) / CAST(100 AS DOUBLE) AS p FROM (SELECT row_id, split, unnest(['gbdt', 'rf', 'lr']) AS model FROM paragraphs WHERE split IS NOT NULL)))"
METRICS = """mt0 AS (SELECT model, split, count(*) AS total_samples, count(*) FILTER (y = 1) AS positive_samples, count(*) FILTER (y = 0) AS negative_samples, CAST(count(*) FILTER (y = 1 AND pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND pred = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND pred = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND pred = 0) AS DOUBLE) AS tn, avg(CASE WHEN p BETWEEN 0.4 AND 0.6 THEN 1.0 ELSE 0.0 END) AS uncertain_ratio FROM sc GROUP BY model, split),
mt1 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END AS f0 FROM mt0),
mt AS (SELECT *, (tp + tn) / total_samples AS accuracy, (f1 + f0) / 2 AS macro_f1 FROM mt1)"""
AUCS = lambda src: f"(SELECT model, split, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT model, split, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM {src} GROUP BY model, split, p)) GROUP BY model, split)"
TARGETS = "tg AS (SELECT s AS split, k AS variant_type, 400 AS target FROM (SELECT unnest(['train', 'dev', 'test']) AS s) a CROSS JOIN (SELECT unnest([" + ", ".join(f"'{k}'" for k in P.VARIANT_TYPES[:5]) + "]) AS k) b)"
ELIGIBLE = "el AS (SELECT * FROM paragraphs WHERE para_type = 'normal' AND coalesce(chapter_role, '') NOT IN (" + ", ".join(f"'{r}'" for r in P.EXCLUDED_ROLES) + "))"
THOUSANDTHS = lambda x: f"array_to_string(list_transform({x}, lambda v: CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR)), ',')"
PROMPT = "CASE variant_type " + " ".join(f"WHEN '{k}' THEN replace({q(t)}, '{{text}}', original_text)" for k, t in TEMPLATES.items()) + " END"

PROCESS = f"{CLEAN}, {CHECK.replace('FROM docs', 'FROM cleaned')}, processed AS (SELECT *, CASE WHEN unread THEN 'error' WHEN len(fixes) > 0 THEN 'fixed' ELSE status END AS final FROM rep JOIN cleaned USING (doc_id))"
SENT = "list_filter(list_transform(regexp_extract_all(text, '[^。！？]*[。！？]|[^。！？]+'), lambda x: " + strip("x") + "), lambda x: x <> '')"
PACK = f"""kp AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, {q(chr(92) + 'n' + P.WS + '*' + chr(92) + 'n')}), lambda x: regexp_replace({strip('x')}, {q(P.WS + '+')}, ' ', 'g')), lambda x: length(x) BETWEEN 100 AND 1000) AS kept, {SENT} AS ss FROM docs),
st AS (SELECT doc_id, kept, ss, 0 AS i, '' AS cur, CAST([] AS VARCHAR[]) AS done FROM kp
 UNION ALL SELECT doc_id, kept, ss, i + 1, CASE WHEN length(cur || ss[i + 1]) >= 200 THEN '' ELSE cur || ss[i + 1] END, CASE WHEN length(cur || ss[i + 1]) BETWEEN 200 AND 1000 THEN list_append(done, cur || ss[i + 1]) ELSE done END FROM st WHERE i < len(ss)),
pk AS (SELECT doc_id, CASE WHEN len(kept) >= 5 THEN kept ELSE list_concat(list_concat(kept, done), CASE WHEN length(cur) >= 100 THEN [substr(cur, 1, 1000)] ELSE CAST([] AS VARCHAR[]) END) END AS paragraphs FROM st WHERE i = len(ss))"""
PROB_ROWS = "pr AS (SELECT row_id, unnest([" + ", ".join(str(i + 1) for i in range(len(P.MODELS))) + f"]) AS j, unnest({NAMES}) AS m, unnest({ALL}) AS p, coalesce(k, 5) AS k, is_ai, confidence, triggered_by FROM fused JOIN probs USING (row_id))"
SQL: dict[str, str] = {
    "flagship_stats_by_role": f"WITH {PARAS}, x AS (SELECT chapter_role, {div(cnt('t', P.HAN), N)} AS c, {div(cnt('t', P.DIGIT), N)} AS g, {div(cnt('t', '[，,]'), N)} AS k, {N} AS n FROM paras) SELECT chapter_role, count(*) AS paragraphs, CAST(sum(n) AS BIGINT) AS chars, {r6('avg(c)')} AS chinese_ratio, {r6('avg(g)')} AS digit_ratio, {r6('avg(k)')} AS comma_ratio FROM x GROUP BY chapter_role",
    "cl1_page_furniture": f"WITH {DOCS} SELECT doc_id, {CL1} AS cleaned FROM docs",
    "cl2b_script_gaps": f"WITH {DOCS} SELECT doc_id, {CL2B} AS cleaned FROM docs",
    "cl3_garbled_chars": f"WITH {DOCS} SELECT doc_id, {CL3} AS cleaned FROM docs",
    "cl4_extra_spaces": f"WITH {DOCS} SELECT doc_id, {CL4} AS cleaned FROM docs",
    "q1_chinese_ratio": f"WITH {DOCS} SELECT doc_id, {r6(CHINESE)} AS chinese_ratio FROM docs",
    "q2_garbled_ratio": f"WITH {DOCS} SELECT doc_id, {r6(GARBLED)} AS garbled_ratio FROM docs",
    "q3_chapter_structure": f"WITH {DOCS} SELECT doc_id, {CHAPTERS} AS has_chapter_structure FROM docs",
    "q4_valid_ending": f"WITH {DOCS} SELECT doc_id, {ENDING} AS has_valid_ending FROM docs",
    "q5_paragraph_kind": f"""WITH {PARAS}, x AS (SELECT row_id, {strip('t')} AS s FROM paras) SELECT row_id, CASE WHEN {m('s', f'^#{{1,6}}{P.WS}+', f'^第{P.NUMERAL}+章')} THEN 'heading' WHEN {m('s', f'^摘要{P.WS}*$')} THEN 'abstract' WHEN {m('s', f'^表(?:{P.WS}|{P.DIGIT})')} THEN 'table_note' WHEN {m('s', f'^图(?:{P.WS}|{P.DIGIT})')} THEN 'figure_note' WHEN {m('s', f'^公式(?:{P.WS}|{P.DIGIT})', chr(94) + '式' + chr(92) + '(')} THEN 'formula_note' WHEN {m('s', '^参考文献')} THEN 'reference' ELSE 'normal' END AS kind FROM x""",
    "cl2a_spaced_letters": f"WITH {DOCS}, {spaced('docs', 'sl', 'cleaned')} SELECT doc_id, cleaned FROM sl",
    "cl5_clean": f"WITH {CLEAN} SELECT doc_id, text AS cleaned, array_to_string(fixes, '|') AS fixes_applied FROM cleaned",
    "q8_process": f"WITH {PROCESS} SELECT doc_id, text AS cleaned, array_to_string(fixes, '|') AS fixes_applied, CAST(char_count AS BIGINT) AS char_count, {r6('chinese_ratio')} AS chinese_ratio, {r6('garbled_ratio')} AS garbled_ratio, has_chapter_structure, has_valid_ending, array_to_string(issues, '|') AS issues, needs_model_fix, final AS status FROM processed",
    "q6_dirty": f"WITH {DOCS} SELECT doc_id, ({DIRTY} OR {GARBLED} > {P.ERROR_GARBLED}) AS needs_model_fix FROM docs",
    "q7_check": f"WITH {DOCS}, {CHECK} SELECT doc_id, CAST(char_count AS BIGINT) AS char_count, {r6('chinese_ratio')} AS chinese_ratio, {r6('garbled_ratio')} AS garbled_ratio, has_chapter_structure, has_valid_ending, array_to_string(issues, '|') AS issues, needs_model_fix, status FROM rep",
    "q9_summary": f"WITH {PROCESS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (final = '{k}') AS {k}" for k in ("passed", "warning", "fixed", "error")) + ", count(*) FILTER (needs_model_fix) AS needs_model FROM processed",
    "sg1_headers": f"WITH {DOCS} SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: {HEADER(strip('l'))})) AS BIGINT) AS headers FROM docs",
    "sg2_dropped": f"WITH {PARAS} SELECT row_id, {DROPPED(strip('t'))} AS dropped FROM paras",
    "sg3_paragraph_type": f"WITH {PARAS} SELECT row_id, {para_type('t')} AS para_type FROM paras",
    "sg4_chapter_role": f"SELECT row_id, {role('chapter')} AS chapter_role FROM (SELECT row_id, coalesce(chapter, '') AS chapter FROM paragraphs)",
    "sg5_flags": f"WITH {PARAS} SELECT row_id, {m('t', P.CITATION)} AS has_citation, {FORMULA('t')} AS has_formula, {m('t', P.TABLE_REF)} AS has_table_ref, {m('t', P.FIGURE_REF)} AS has_figure_ref FROM paras",
    "sg6_sentences": f"WITH {PARAS} SELECT row_id, CAST({SENTENCES('t')} AS BIGINT) AS sentence_count FROM paras",
    "sg7_segment": f"WITH {DOCS}, {SEGMENT} SELECT * FROM seg",
    "sg8_word_count": f"WITH {PARAS} SELECT row_id, CAST({cnt('t', P.HAN)} AS BIGINT) AS word_count FROM paras",
    "sg9_usable_lengths": f"WITH {DOCS}, {SEGMENT} SELECT doc_id, para_index, char_count FROM seg WHERE char_count BETWEEN {P.MIN_LENGTH} AND {P.MAX_LENGTH}",
    "sg10_distributions": "SELECT 'para_type' AS dimension, para_type AS value, count(*) AS n FROM paragraphs GROUP BY para_type UNION ALL SELECT 'chapter_role', chapter_role, count(*) FROM paragraphs GROUP BY chapter_role UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM paragraphs GROUP BY year",
    "md1_paper_hash": f"WITH {DOCS} SELECT doc_id, sha256(substr(text, 1, 2000))[1:16] AS paper_hash FROM docs",
    "md2_year_of_path": f"SELECT DISTINCT source_path, CAST({YEAR_PATH} AS INT) AS year FROM documents_metadata",
    "md3_title": f"WITH {DOCS} SELECT doc_id, {TITLE} AS title FROM docs",
    "md4_school": f"WITH {DOCS} SELECT doc_id, {SCHOOL} AS school FROM docs",
    "md5_major": f"WITH {DOCS} SELECT doc_id, {MAJOR} AS major FROM docs",
    "md6_author": f"WITH {DOCS} SELECT doc_id, {AUTHOR} AS author FROM docs",
    "md7_chapter_count": f"WITH {DOCS} SELECT doc_id, CAST({CHAPTER_COUNT} AS BIGINT) AS chapter_count FROM docs",
    "md8_assemble": f"""WITH {DOCS}, p AS (SELECT doc_id, '/corpus/' || year || '/x/' || doc_id || '.md' AS source_path FROM documents), x AS (SELECT doc_id, text, {YEAR_PATH} AS year, {TITLE} AS title, {SCHOOL} AS school, {MAJOR} AS major, {AUTHOR} AS author, source_path FROM docs JOIN p USING (doc_id))
 SELECT doc_id, sha256(substr(text, 1, 2000))[1:16] AS paper_hash, CAST(year AS INT) AS year, title, school, major, author, CAST(length(text) AS BIGINT) AS char_count, CAST({CHAPTER_COUNT} AS BIGINT) AS chapter_count, source_path, CASE WHEN year > 0 THEN year || '_' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS source_doc_id, array_to_string(list_filter([CASE WHEN year = 0 THEN 'year' END, CASE WHEN title = '' THEN 'title' END, CASE WHEN school = '' THEN 'school' END, CASE WHEN major = '' THEN 'major' END, CASE WHEN author = '' THEN 'author' END], lambda x: x IS NOT NULL), ',') AS missing_fields, NOT (year = 0 OR title = '' OR school = '' OR major = '' OR author = '') AS has_complete_metadata FROM x""",
    "md9_paragraph_counts": "SELECT m.doc_id, CAST(p.n AS INT) AS para_count FROM (SELECT DISTINCT doc_id FROM documents_metadata) m JOIN (SELECT doc_id, count(*) AS n FROM paragraphs GROUP BY doc_id) p USING (doc_id)",
    "md10_completeness": "SELECT year, count(*) AS documents, count(*) FILTER (has_complete_metadata) AS complete FROM documents_metadata GROUP BY year",
    "md10_missing_fields": "SELECT field, count(*) AS n FROM (SELECT unnest(missing_fields) AS field FROM documents_metadata) GROUP BY field",
    "src12_parent_year": f"SELECT DISTINCT source_path, CASE WHEN regexp_matches({FOLDER(1)}, '^[0-9]{{1,9}}$') THEN CAST(CASE WHEN regexp_matches({FOLDER(1)}, '^[0-9]{{1,9}}$') THEN {FOLDER(1)} END AS INT) ELSE 0 END AS year FROM documents_metadata",
    "src13_stem": f"SELECT DISTINCT source_path, {STEM} AS doc_id FROM documents_metadata",
    "snk2_report_rows": f"WITH {PROCESS} SELECT doc_id, CASE WHEN len(fixes) > 0 THEN 'fixed' ELSE status END AS status, CAST(char_count AS BIGINT) AS char_count, round(chinese_ratio, 4) AS chinese_ratio, round(garbled_ratio, 4) AS garbled_ratio, has_chapter_structure, has_valid_ending, CAST(len(issues) AS BIGINT) AS issues, array_to_string(fixes, '|') AS fixes_applied, needs_model_fix FROM processed",
    "snk4_key_mapping": "SELECT paper_hash, source_doc_id, doc_id, year, has_complete_metadata FROM documents_metadata",
    "sp1_documents_by_year": "SELECT year, count(DISTINCT doc_id) AS documents FROM documents_metadata WHERE year > 0 AND coalesce(doc_id, '') <> '' GROUP BY year",
    "sp2_documents_by_split": f"WITH {DOCSPLIT} SELECT * FROM ds",
    "sp3_paragraphs_in_split": f"WITH {DOCSPLIT} SELECT row_id FROM paragraphs WHERE doc_id IN (SELECT doc_id FROM ds WHERE split = 'dev')",
    "sp4_hardness": f"SELECT row_id, CAST({SCORE} AS DOUBLE) AS score FROM paragraphs",
    "sp5_sp7_hard_samples": f"WITH {HARD} SELECT row_id, split, score, hard FROM hard",
    "sp8_statistics": f"WITH {HARD} SELECT split, count(DISTINCT doc_id) AS docs, count(*) AS paras_before, count(*) FILTER (NOT hard) AS paras_standard, count(*) FILTER (hard) AS paras_hard, count(DISTINCT CASE WHEN hard THEN doc_id END) AS hard_docs FROM hard GROUP BY split",
    "sp9_split_index": f"WITH {DOCSPLIT} SELECT doc_id, ['train', 'dev', 'test'][max(CASE split WHEN 'train' THEN 1 WHEN 'dev' THEN 2 ELSE 3 END)] AS split FROM ds GROUP BY doc_id",
    "sp10_hard_index": f"WITH {HARD} SELECT DISTINCT doc_id, split || '_hard' AS split FROM hard WHERE hard",
    "fx1_split_of_year": f"SELECT row_id, {SPLIT_OF('year')} AS split FROM variants",
    "fx2_repaired_years": f"WITH {FIXED} SELECT row_id, y AS year, updated FROM fixed",
    "fx3_misplaced": f"WITH {FIXED} SELECT row_id, target_split, misplaced FROM mis",
    "fx4_moved": f"WITH {FIXED}, there AS (SELECT DISTINCT split AS target_split, variant_type, doc_id, key FROM mis WHERE NOT misplaced), go AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_split, variant_type, doc_id, key ORDER BY row_id) AS rn FROM mis WHERE misplaced) WHERE rn = 1) SELECT row_id, split AS final_split FROM mis WHERE NOT misplaced UNION ALL SELECT row_id, target_split FROM go WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.target_split = go.target_split AND t.variant_type = go.variant_type AND t.doc_id = go.doc_id AND t.key = go.key)",
    "fx5_validation": "SELECT row_id, array_to_string(list_filter([CASE WHEN original_text IS NULL THEN 'missing original_text' WHEN variant_text IS NULL THEN 'missing variant_text' WHEN variant_type IS NULL THEN 'missing variant_type' WHEN doc_id IS NULL THEN 'missing doc_id' WHEN year IS NULL THEN 'missing year' END, CASE WHEN coalesce(year, 0) = 0 THEN 'year=0' END], lambda x: x IS NOT NULL), '|') AS errors FROM variants WHERE original_text IS NULL OR variant_text IS NULL OR variant_type IS NULL OR doc_id IS NULL OR coalesce(year, 0) = 0",
    "fx6_year_histogram": "SELECT split, variant_type, year, count(*) AS n FROM variants GROUP BY split, variant_type, year",
    "vg1_eligible": f"WITH {ELIGIBLE} SELECT row_id FROM el",
    "vg2_unprocessed": f"WITH {ELIGIBLE} SELECT row_id FROM el WHERE NOT EXISTS (SELECT 1 FROM variants v WHERE v.doc_id = el.doc_id || '_' || el.para_index)",
    "vg3_quota": f"WITH {ELIGIBLE}, {TARGETS}, need AS (SELECT split, variant_type, greatest(0, target - coalesce(n, 0)) AS need FROM tg LEFT JOIN (SELECT split, variant_type, count(*) AS n FROM variants GROUP BY 1, 2) c USING (split, variant_type)), r AS (SELECT row_id, split, text, row_number() OVER (PARTITION BY split ORDER BY row_id) AS rn FROM el) SELECT r.row_id, r.split, need.variant_type FROM r JOIN need ON r.split = need.split AND r.rn <= need.need WHERE length(text) BETWEEN 50 AND 2000",
    "vg4_prompts": f"SELECT row_id, {PROMPT} AS prompt, CASE variant_type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in P.TEMPERATURE.items()) + " END AS temperature FROM variants",
    "vg9_fan_out": f"WITH {TARGETS} SELECT * FROM tg",
    "vg10_progress": f"WITH {TARGETS} SELECT split, variant_type, coalesce(n, 0) AS current, target, {r6('CASE WHEN coalesce(n, 0) >= target THEN 100 ELSE coalesce(n, 0) * 100.0 / target END')} AS percentage FROM tg LEFT JOIN (SELECT split, variant_type, count(*) AS n FROM variants GROUP BY 1, 2) c USING (split, variant_type)",
    "fv1_online_features": f"""WITH {PARAS}, x AS (SELECT row_id, t, {ONLINE_S} AS s, list_filter(string_split_regex(t, {q(P.WS + '+')}), lambda w: w <> '') AS w FROM paras),
 y AS (SELECT *, {div('list_sum(list_transform(s, lambda v: length(v)))', 'len(s)')} AS a FROM x), z AS (SELECT *, sqrt({div('list_sum(list_transform(s, lambda v: (length(v) - a) * (length(v) - a)))', 'len(s)')}) AS sd FROM y)
 SELECT row_id, {r6('a')} AS avg_sentence_length, {r6('sd')} AS sentence_length_std, {r6(div(cnt('t', '[，,]'), N))} AS comma_ratio, {r6(div(cnt('t', '[。.]'), N))} AS period_ratio, {r6(div(subs('t', P.PRONOUNS), N))} AS pronoun_ratio, {r6(div(subs('t', P.CONJUNCTIONS), N))} AS conjunction_ratio,
 {r6(div("len(list_distinct(regexp_extract_all(t, '(?s).')))", N))} AS unique_word_ratio, {r6(div('list_sum(list_transform(w, lambda v: length(v)))', 'len(w)'))} AS avg_word_length, {r6(div(cnt('t', f'[{P.DIGIT}{OTHER_DIGITS}]'), N))} AS digit_ratio, {r6(div(cnt('t', P.HAN), N))} AS chinese_char_ratio, CAST({N} AS BIGINT) AS paragraph_length, {r6(div('sd', 'a'))} AS burstiness, {r6(div(subs('t', P.FORMAL), N))} AS formality_score FROM z""",
    "fv2_training_features": f"""WITH {PARAS}, x AS (SELECT row_id, t, {TRAIN_S} AS s, {HANS} AS h FROM paras) SELECT row_id, CAST({N} AS BIGINT) AS char_count, CAST({cnt('t', P.SENTENCE_END)} + 1 AS BIGINT) AS sentence_count, {r6(div('len(h)', N))} AS chinese_ratio, {r6(div(cnt('t', '[a-zA-Z]'), N))} AS english_ratio, {r6(div(cnt('t', P.DIGIT), N))} AS digit_ratio,
 CAST({cnt('t', '[，,]')} AS BIGINT) AS comma_count, CAST({cnt('t', '[。.]')} AS BIGINT) AS period_count, CAST({cnt('t', '[；;]')} AS BIGINT) AS semicolon_count, CAST({cnt('t', '[：:]')} AS BIGINT) AS colon_count, {r6(div('len(list_distinct(h))', 'len(h)'))} AS vocab_diversity, {r6(div('list_sum(list_transform(s, lambda v: length(v)))', 'len(s)'))} AS avg_sentence_length,
 CAST({m('t', rf'\[{P.DIGIT}+\]')} AS INT) AS has_citation, CAST({m('t', '[=∑∏∫√∂]')} AS INT) AS has_formula, CAST({m('t', P.TABLE_REF)} AS INT) AS has_table_ref, CAST({m('t', P.FIGURE_REF)} AS INT) AS has_figure_ref FROM x""",
    "emb3_emb4_combine": f"SELECT vec_id, {THOUSANDTHS('list_concat(s, e)')} AS online, {THOUSANDTHS('list_concat(e, s)')} AS training, {THOUSANDTHS('e')} AS tail FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e, [CAST(vec_id AS DOUBLE), CAST(label AS DOUBLE), CAST(3 AS DOUBLE)] AS s FROM embeddings)",
    "snk7_src11_feature_rows": f"SELECT vec_id, {THOUSANDTHS('CASE vec_id % 3 WHEN 0 THEN list_concat(e, [CAST(1 AS DOUBLE)]) WHEN 1 THEN list_concat(e, [CAST(2 AS DOUBLE), 3]) ELSE list_concat(e, [CAST(vec_id AS DOUBLE), 0, 0, 0, 4, 0]) END')} AS features, label, 'standard' AS difficulty_level, 'human' AS generation_path FROM (SELECT vec_id, CAST(label % 2 AS INT) AS label, list_transform(embedding[1:4], lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)",
    "sg11_scoring_paragraphs": f"WITH RECURSIVE {DOCS}, {PACK} SELECT doc_id, array_to_string(paragraphs, chr(9246)) AS paragraphs FROM pk",
    "vg5_vg6_generate": f"SELECT row_id, replace(replace(replace(original_text, '研究', '分析'), '因此', '所以'), '企业', '公司') AS answer, TRUE AS ok, CAST(200 AS INT) AS status, 'main' AS provider FROM variants WHERE {PROMPT} IS NOT NULL",
    "vg6_run_statistics": f"SELECT 'main' AS provider, count(*) AS calls, count(*) FILTER (length({PROMPT}) % 2 = 0) AS ok, count(*) FILTER (length({PROMPT}) % 2 = 1) AS failed FROM variants WHERE {PROMPT} IS NOT NULL",
    "vg10_overall": f"WITH {TARGETS}, c AS (SELECT split, variant_type, count(*) AS n FROM variants GROUP BY 1, 2), o AS (SELECT CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_current, CAST(sum(target) AS BIGINT) AS total_target FROM tg LEFT JOIN c USING (split, variant_type)), r AS (SELECT *, total_current * 100.0 / CAST(total_target AS DOUBLE) AS pct FROM o) SELECT total_current, total_target, {r6('pct')} AS total_percentage, CAST(10 AS INT) AS elapsed_minutes, CAST(CASE WHEN total_current > 0 AND pct < 100 THEN floor((600 / (pct / 100.0) - 600) / 60) ELSE 0 END AS INT) AS remaining_minutes FROM r",
    "ca3_report_lines": f"WITH {PROBS}, {CAL}, {CALDOC}, r AS (SELECT doc_id, a, {DOC_RISK} AS level, ai_paragraph_count AS x, total_paragraphs AS n, ai_paragraph_count / CAST(total_paragraphs AS DOUBLE) AS share, a * 100 AS pa, ai_paragraph_count / CAST(total_paragraphs AS DOUBLE) * 100 AS ps FROM cd) SELECT doc_id, printf('%s: %.1f%% %s, %d/%d (%.1f%%)', doc_id, pa, level, x, n, ps) AS line, concat_ws(chr(10), repeat('=', 60), 'AIGC检测结果 (CNKI校准版)', repeat('=', 60), '', printf('文档级AIGC分数: %.1f%%', pa), '风险等级: ' || level, printf('AI段落: %d/%d (%.1f%%)', x, n, ps), '', '说明: 该分数经过CNKI校准，更接近知网AIGC检测的AI特征值', '', '风险阈值参考:', '  - 低风险: <15%', '  - 中风险: 15-30%', '  - 较高风险: 30-50%', '  - 高风险: >50%', repeat('=', 60)) AS report FROM r",
    "snk10_detection_json": f"WITH {PROBS}, {FUSED}, o AS (SELECT *, {RISK} AS risk, row_number() OVER (PARTITION BY doc_id ORDER BY para_index, is_ai, confidence, triggered_by) AS rn FROM fused) SELECT doc_id, {r6('avg(confidence)')} AS score, count(*) AS n, count(*) FILTER (risk = 'high') AS high, CAST(least(count(*), 20) AS BIGINT) AS shown, string_agg(CASE WHEN rn <= 20 THEN para_index || ':' || triggered_by || ':' || risk END, ',' ORDER BY rn) AS paragraphs FROM o GROUP BY doc_id",
    "tr2_train_time": f"WITH {SCORED}, {METRICS}, hd AS (SELECT * FROM sc WHERE difficulty = 'hard'), a AS (SELECT * FROM {AUCS('sc')}), b AS (SELECT * FROM {AUCS('hd')}) SELECT model, split, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, {r6('a.auc')} AS auc, {r6('b.auc')} AS hard_auc FROM mt LEFT JOIN a USING (model, split) LEFT JOIN b USING (model, split)",
    "ev7_evaluation": f"WITH {SCORED}, {METRICS}, hd AS (SELECT * FROM sc WHERE difficulty = 'hard'), a AS (SELECT * FROM {AUCS('sc')}), b AS (SELECT * FROM {AUCS('hd')}) SELECT model, split, total_samples, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, {r6('a.auc')} AS auc, {r6('b.auc')} AS hard_auc, {r6('uncertain_ratio')} AS uncertain_ratio, FALSE AS failed FROM mt LEFT JOIN a USING (model, split) LEFT JOIN b USING (model, split) WHERE split <> 'train' UNION ALL SELECT 'broken', s, 0, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM (SELECT unnest(['dev', 'test', 'dev_hard', 'test_hard']) AS s)",
    "snk5_split_index": f"WITH {HARD} SELECT DISTINCT doc_id, split FROM hard UNION ALL SELECT DISTINCT doc_id, split || '_hard' FROM hard WHERE hard AND split <> 'train'",
    "fe1_human_rows": HUMAN,
    "fe2_variant_errors": f"SELECT row_id, {VERR} AS error FROM variants",
    "fe3_variant_rows": AIROWS,
    "fe4_training_rows": f"SELECT label, difficulty_level, generation_path, split, count(*) AS n FROM ({HUMAN} UNION ALL {AIROWS}) GROUP BY 1, 2, 3, 4",
    "fe5_variant_breakdown": f"SELECT split, variant_type, count(*) AS total, count(*) FILTER (e IS NULL) AS valid, count(*) FILTER (e IS NOT NULL) AS invalid FROM (SELECT split, variant_type, {VERR} AS e FROM variants) GROUP BY split, variant_type",
    "fe6_totals": f"WITH r AS ({HUMAN} UNION ALL {AIROWS}) SELECT CASE WHEN grouping(split) = 1 THEN '*' ELSE coalesce(split, '?') END AS split, CASE WHEN grouping(generation_path) = 1 THEN '*' ELSE generation_path END AS generation_path, count(*) AS n, CAST(sum(label) AS BIGINT) AS positive, {r6('100.0 * count(*) / (SELECT count(*) FROM r)')} AS percent FROM r GROUP BY ROLLUP (split, generation_path)",
    "fu2_fuse": f"WITH {PROBS}, {FUSED} SELECT row_id, is_ai, confidence, triggered_by, CAST(coalesce(k, 5) AS BIGINT) AS evaluated FROM fused",
    "fu3_fused_probability": f"WITH {PROBS}, {FUSED} SELECT row_id, confidence AS first_trigger, max_prob FROM fused",
    "fu5_descriptors": "SELECT * FROM (VALUES ('select5_tree_d2', 5, FALSE, TRUE), ('select10_tree_d2', 10, FALSE, TRUE), ('select15_tree_d3', 15, FALSE, TRUE), ('select20_tree_d2', 20, FALSE, TRUE), ('bert_tree_d1', 768, TRUE, FALSE)) AS v(model, feature_dim, use_embedding, has_selector)",
    "fu6_explanations": f"WITH {PROBS}, {FUSED}, {PROB_ROWS.replace('FROM fused JOIN probs USING (row_id)', 'FROM (SELECT f.*, ' + ', '.join(f'p.{k}' for k in P.MODELS) + ' FROM fused f JOIN probs p USING (row_id))')} SELECT row_id, concat_ws(chr(10), 'AIGC检测结果: ' || any_value(CASE WHEN is_ai THEN '高风险' ELSE '低风险' END), '触发阈值: 0.35', '最高置信度: ' || printf('%.3f', any_value(confidence)), '触发模型: ' || any_value(triggered_by), '', '各模型概率:', string_agg(printf('  %-20s: %.3f', m, p) || CASE WHEN p > 0.35 THEN ' ✓' ELSE '' END, chr(10) ORDER BY p DESC, j)) AS explanation FROM pr WHERE j <= k GROUP BY row_id",
    "fu7_paragraph_risk": f"WITH {PROBS}, {FUSED} SELECT row_id, {RISK} AS risk FROM fused",
    "fu8_document_scores": f"WITH {PROBS}, {FUSED}, d AS (SELECT doc_id, avg(confidence) AS s, count(*) AS n, count(*) FILTER ({RISK} = 'high') AS h, count(*) FILTER ({RISK} = 'medium') AS md, count(*) FILTER ({RISK} = 'low') AS lo FROM fused GROUP BY doc_id) SELECT m.doc_id, {r6('coalesce(s, 0)')} AS doc_ai_score, coalesce(n, 0) AS n, coalesce(h, 0) AS high_risk_count, coalesce(md, 0) AS medium_risk_count, coalesce(lo, 0) AS low_risk_count, {r6('CASE WHEN n > 0 THEN h / n ELSE 0 END')} AS high_share FROM (SELECT DISTINCT doc_id FROM documents_metadata) m LEFT JOIN d USING (doc_id)",
    "fu8_paragraph_list": f"WITH {PROBS}, {FUSED} SELECT doc_id, CAST(least(count(*), 20) AS BIGINT) AS shown, CAST(min(para_index) AS BIGINT) AS first_id FROM fused GROUP BY doc_id",
    "ca1_fuse_calibrated": f"WITH {PROBS}, {CAL} SELECT row_id, is_ai, raw_probability, {r6('calibrated_score')} AS calibrated_score, triggered_by FROM cal",
    "ca2_document_scores": f"WITH {PROBS}, {CAL}, {CALDOC} SELECT doc_id, {r6('a')} AS doc_calibrated_score, {r6(f'a / {P.CALIBRATION}')} AS doc_raw_score, {DOC_RISK} AS risk_level, ai_paragraph_count, total_paragraphs, {r6('ai_paragraph_count / CAST(total_paragraphs AS DOUBLE)')} AS ai_ratio FROM cd",
    "ev1_metrics": f"WITH {SCORED}, {METRICS} SELECT model, split, total_samples, positive_samples, negative_samples, {', '.join(r6(c) + ' AS ' + c for c in ('precision', 'recall', 'f1', 'accuracy', 'macro_f1', 'uncertain_ratio'))} FROM mt",
    "ev2_auc": f"WITH {SCORED} SELECT model, split, {r6('auc')} AS auc FROM {AUCS('sc')}",
    "ev3_confusion": f"WITH {SCORED} SELECT model, split, y, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM sc GROUP BY model, split, y",
    "ev4_by_difficulty": f"WITH {SCORED}, st AS (SELECT * FROM sc WHERE difficulty = 'standard'), hd AS (SELECT * FROM sc WHERE difficulty = 'hard'), a AS (SELECT * FROM {AUCS('st')}), b AS (SELECT * FROM {AUCS('hd')}), c AS (SELECT model, split, count(*) FILTER (y = 1 AND pred = 1) / CAST(nullif(count(*) FILTER (y = 1), 0) AS DOUBLE) AS r, count(*) FILTER (y = 1 AND pred = 1) / CAST(nullif(count(*) FILTER (pred = 1), 0) AS DOUBLE) AS pt FROM hd GROUP BY model, split) SELECT model, split, {r6('a.auc')} AS standard_auc, {r6('b.auc')} AS hard_auc, {r6('CASE WHEN b.auc IS NOT NULL THEN r END')} AS hard_precision, {r6('CASE WHEN b.auc IS NOT NULL THEN r END')} AS hard_recall, {r6('CASE WHEN b.auc IS NOT NULL THEN pt END')} AS hard_precision_true FROM a FULL JOIN b USING (model, split) LEFT JOIN c USING (model, split)",
    "ev6_overfit_risk": f"WITH {SCORED}, {METRICS} SELECT a.model, {r6('a.f1 - b.f1')} AS gap, CASE WHEN a.f1 - b.f1 > 0.2 THEN 'high' WHEN a.f1 - b.f1 > 0.1 THEN 'medium' ELSE 'low' END AS risk FROM mt a JOIN mt b ON a.model = b.model AND a.split = 'dev' AND b.split = 'dev_hard'",
    "tr3_best_model": f"WITH {SCORED}, {METRICS} SELECT model, split, {r6('f1')} AS f1 FROM mt WHERE split = 'dev_hard' ORDER BY f1 DESC, list_position(['gbdt', 'rf', 'lr'], model) LIMIT 1",
    "ev8_summary": f"WITH {SCORED}, {METRICS} SELECT printf('%s %s: F1 %.3f, precision %.3f, recall %.3f, uncertain %.1f%%', model, split, f1, precision, recall, uncertain_ratio * 100) AS line FROM mt",
}

"""SQL views that state the derived inputs of ``fixtures`` for the comparison engine."""

from __future__ import annotations

import re

# Letters beyond ASCII in the test texts; the comparison engine counts bytes, so they map to control codes.
LETTERS = "èéêçÉÈÊößäüÄÖóíñÇÓÑÍÜ"
CODES = "||".join(f"chr({c})" for c in [*range(1, 9), *range(14, 27)])
NL = "chr(10)"
WS = "' '||chr(9)||chr(10)||chr(13)"


def folded(col: str) -> str:
    return f"translate({col}, '{LETTERS}', {CODES})"


def strip(col: str) -> str:
    return f"trim({col}, {WS})"


def word_list(col: str) -> str:
    return f"list_filter(string_split_regex({col}, '\\s+'), lambda w: w <> '')"


_STYLE = "(VALUES (20),(28),(36)) f(font_size), (VALUES (0),(6),(24),(42)) l(line_spacing), (VALUES (-1),(0),(7)) c(letter_spacing)"
_RES = "(VALUES (512),(640),(1024),(1280)) r(resolution)"
_MARKS = {
    "chapter": "'  CHAPTER '||(['IV','12','A1','XIX','MCM'])[((i-1)//3)%5+1]||'. Of things'||chr(10)",
    "numbered": "'chapter '||((i-1)//3+1)||' : Title'||chr(10)",
    "headed": "'Chapter '||((i-1)//3+1)||'.'||chr(10)||chr(10)||'OF THE TITLE'||chr(10)||chr(10)",
    "separator": "chr(10)||'  ------- '||chr(10)",
    "letter": "CASE WHEN ((i-1)//3)%2=0 THEN '_Dear Pierrepont:_ ' ELSE 'Your affectionate father,'||chr(10)||'JOHN GRAHAM.'||chr(10) END",
}


def _book(form: str) -> str:
    return (
        "SELECT doc_id, 'book_'||doc_id AS book_name, array_to_string(list_transform(string_split(text, chr(10)), "
        f"lambda x, i: CASE WHEN (i-1)%3=0 THEN ({_MARKS[form]})||x ELSE x END), chr(10)) AS text FROM documents"
    )


VIEWS = {
    "ocr_blocks": f"""
SELECT 'doc_'||doc_id||'_'||block AS id, doc_id, block, lang, source, ground_truth,
  replace(replace(substring(ground_truth, 1, CAST(floor(length(ground_truth)*share/100) AS INT)), 'the', 'tbe'), 'io', 'lo') AS prediction
FROM (SELECT *, CASE WHEN (doc_id*31+block*7)%5=0 THEN 40+(doc_id+block*7)%41 ELSE 100 END AS share FROM (
  SELECT doc_id, lang, source, block, substring(t, CAST(block*400+1 AS INT), 400) AS ground_truth FROM (
    SELECT doc_id, lang, source, t, unnest(range(0, CAST((length(t)-1)//400 AS BIGINT)+1)) AS block FROM (
      SELECT doc_id, lang, source, {strip("regexp_replace(text, '\\s+', ' ', 'g')")} AS t FROM documents) WHERE length(t)>0)))""",
    "ocr_tokens": f"""
SELECT id, doc_id, lang, prediction, ground_truth, {word_list('ground_truth')} AS ref, {word_list('prediction')} AS hyp FROM ocr_blocks""",
    "analysis_points": f"""
SELECT image_id, font_size, line_spacing, letter_spacing, resolution, CAST(text_len AS INT) AS text_len, CAST(text_len//4 AS INT) AS token_len,
  cw AS character_width, ch AS character_height, 256.0::DOUBLE*text_len/(resolution*resolution) AS patch_density,
  round(CASE WHEN u2 < 1/(1+exp(-z)) THEN least(0.999::DOUBLE, 0.62::DOUBLE+0.33::DOUBLE*u) ELSE 0.0608::DOUBLE*u END, 6) AS edit_distance
FROM (SELECT *, w0 + 2.91046860622506::DOUBLE*ln((cw+letter_spacing)*text_len/(ch+line_spacing)) + 5.534691214157865::DOUBLE*ln(text_len/power(resolution/64.0::DOUBLE, 2)) AS z,
    ((doc_id*7919+sidx*104729+resolution*31)%1000)/1000.0::DOUBLE AS u, ((doc_id*611953+sidx*7907+resolution*17)%997)/997.0::DOUBLE AS u2
  FROM (SELECT 'doc_'||doc_id AS image_id, doc_id, n_chars*4 AS text_len, font_size, line_spacing, letter_spacing, resolution,
      font_size*100+line_spacing*10+letter_spacing+1 AS sidx,
      CASE font_size WHEN 20 THEN 10.0369::DOUBLE WHEN 28 THEN 14.0533::DOUBLE ELSE 18.0624::DOUBLE END AS cw,
      CASE font_size WHEN 20 THEN 19.0::DOUBLE WHEN 28 THEN 26.0::DOUBLE ELSE 33.0::DOUBLE END AS ch,
      CASE resolution WHEN 512 THEN -45.5724119331014::DOUBLE WHEN 640 THEN -46.13850916228606::DOUBLE WHEN 1024 THEN -46.23202179601734::DOUBLE ELSE -42.99133143004373::DOUBLE END AS w0
    FROM documents, {_STYLE}, {_RES}))""",
    "metric_records": """
SELECT image_id AS id, resolution, text_len, token_len AS text_token_len, edit_distance AS edit_dist FROM analysis_points
WHERE font_size=28 AND line_spacing=6 AND letter_spacing=0""",
    "images": """
SELECT 'pages/doc_'||doc_id||'.png' AS image, 'doc_'||doc_id AS id, doc_id, n_chars, CAST(300+(n_chars*3)%4000 AS INT) AS width,
  CAST(400+(n_chars*7)%3900 AS INT) AS height FROM documents""",
    "ground_truth": """
SELECT 'doc_'||doc_id AS id, text AS gt, doc_id AS pos, CAST(n_chars//4 AS INT) AS text_token_len, CAST(n_chars AS INT) AS text_len
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "predictions": """
SELECT 'doc_'||doc_id AS id, '# '||replace(text, chr(10), chr(10)||chr(10)||'- ')||chr(10)||'![fig](images/0.jpg) [link](http://x.y/z)' AS markdown
FROM documents WHERE doc_id IN (SELECT page_id FROM pages)""",
    "plain_predictions": f"""
SELECT id, {strip("array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(markdown, '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), chr(10)), lambda x: " + strip('x') + "), lambda x: x <> ''), lambda x: regexp_replace(x, '^[#>*\\-\\d.)(]+\\s*', '')), ' ')")} AS answer FROM predictions""",
    **{f"book_{f}": _book(f) for f in _MARKS},
    "layout_blocks": """
SELECT doc_id AS page_id, i, CAST(i AS INT) AS anno_id, (['title','text_block','Text_Block','figure_caption','text_block','page_number','text_block'])[(i+doc_id)%7+1] AS category_type,
  CASE WHEN i%11<>10 THEN CAST((i*5)%7+i AS INT) END AS ord, (i%6=5) AS ign,
  CASE WHEN i%9<>8 THEN 40.5::DOUBLE+(i*13)%50 END AS x0, CASE WHEN i%9<>8 THEN 30.25::DOUBLE+(i*97)%2000 END AS y0,
  CASE WHEN i%9<>8 THEN 40.5::DOUBLE+(i*13)%50+200.0::DOUBLE+length(x)%900 END AS x1, CASE WHEN i%9<>8 THEN 30.25::DOUBLE+(i*97)%2000+60.0::DOUBLE END AS y1, x AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1)-1 AS i FROM documents)""",
    "layout_names": """
SELECT doc_id AS page_id, CASE WHEN lang='en' THEN 'newspaper_' ELSE 'book_' END||source||'_'||doc_id||'.jpg' AS image_path, lang FROM documents""",
    "tagged_lines": """
SELECT doc_id, x, i, '<|ref|>'||CASE WHEN i%3=1 THEN 'image' ELSE 'text' END||'<|/ref|><|det|>[['||(i*7%500)||', '||(i*11%500)||', '||(500+i*13%499)||', '||CASE WHEN i%5=4 THEN 'x' ELSE CAST(500+i*17%499 AS VARCHAR) END||']]<|/det|>' AS tag
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1)-1 AS i FROM documents)""",
    "tagged_output": """
SELECT d.doc_id, d.doc_id%50 AS pdf, n_chars, t.body||' \\coloneqq <center>x</center>'||CASE WHEN n_chars<5000 THEN '<｜end▁of▁sentence｜>' ELSE '' END AS content
FROM documents d JOIN (SELECT doc_id, string_agg(tag||chr(10)||x, chr(10)||chr(10)||chr(10) ORDER BY i) AS body FROM tagged_lines GROUP BY doc_id) t USING (doc_id)""",
    "binned": """
SELECT resolution, font_size, line_spacing, letter_spacing, CAST(text_len//100 AS BIGINT) AS bin, quantile_cont(edit_distance, 0.9) AS q_high, quantile_cont(edit_distance, 0.1) AS q_low, count(*) AS n
FROM analysis_points GROUP BY ALL""",
    "bins": """
SELECT g.*, coalesce(b.q_high, 0) AS q_high, coalesce(b.q_low, 0) AS q_low, coalesce(b.q_high, 0)-coalesce(b.q_low, 0) AS q_diff, coalesce(b.n, 0) AS n
FROM (SELECT resolution, font_size, line_spacing, letter_spacing, unnest(range(lo, hi+1)) AS bin FROM (SELECT resolution, font_size, line_spacing, letter_spacing, min(bin) AS lo, max(bin) AS hi FROM binned GROUP BY ALL)) g
LEFT JOIN binned b USING (resolution, font_size, line_spacing, letter_spacing, bin)""",
    "em_points": """
SELECT *, (character_width+letter_spacing)/(character_height+line_spacing) AS V, power(resolution/64.0::DOUBLE, 2) AS vision_token_num,
  ln((character_width+letter_spacing)/(character_height+line_spacing)) AS logV, ln(text_len/power(resolution/64.0::DOUBLE, 2)) AS logG,
  least(greatest(edit_distance, 1e-6::DOUBLE), 1-1e-6::DOUBLE) AS y FROM analysis_points""",
    "log_points": """
SELECT *, CASE WHEN keep THEN lx END AS x, CASE WHEN keep THEN ly END AS yy FROM (
  SELECT *, coalesce(ly >= -6 AND lx >= CASE WHEN resolution=1280 THEN 9.15::DOUBLE ELSE '-inf'::DOUBLE END, false) AS keep FROM (
    SELECT *, CASE WHEN edit_distance>0 AND text_len>0 THEN ln(edit_distance) END AS ly, CASE WHEN edit_distance>0 AND text_len>0 THEN ln(text_len) END AS lx FROM analysis_points))""",
}


def with_views(body: str) -> str:
    """Prefix a query with the views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    extra = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if extra.startswith(head):
            return f"{head}{ctes},\n{extra[len(head):]}"
    return f"WITH {ctes}\n{extra}"

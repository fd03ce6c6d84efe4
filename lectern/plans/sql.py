"""The queries' results in standard SQL, for an engine without look-around in patterns."""

from __future__ import annotations

CHAPTER = "book_id, spine_idx"
SENTENCE = "book_id, spine_idx, para_idx, sent_idx"
CLAUSES = "'that','which','who','whom','whose','because','although','though','while','if','unless','until','since','when','where','whether','as'"
ENDS = "'.','!','?','。','！','？','’','\"','*'"
SPACE = r"[\s\x0b\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"



SPLIT = r"""
paras AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS pi FROM docs),
parts AS (SELECT doc_id, pi, regexp_extract_all(p, '[^.!?。！？\n]+[.!?。！？’"*]*', 0) AS ss FROM paras),
sents AS (SELECT doc_id, pi, CAST(generate_subscripts(ss, 1) - 1 AS INT) AS si, trim(unnest(ss), ' ') AS s FROM parts)
"""
EN = "docs AS (SELECT doc_id, text FROM documents),"
ALPHA = rf"len(list_filter(regexp_split_to_array(s, '{SPACE}+'), lambda w: regexp_full_match(w, '\p{{L}}+')))"
KEPT = f"kept AS (SELECT * FROM sents WHERE length(s) >= 5 AND right(s, 1) IN ({ENDS}) AND {ALPHA} > 3)"
FEATS = rf"""
feats AS (SELECT *,
  len(regexp_extract_all(s, '[\p{{L}}\p{{M}}]+|\p{{N}}+|[^\s\p{{L}}\p{{M}}\p{{N}}]')) AS n_tok,
  len(regexp_extract_all(s, '[\p{{L}}\p{{M}}]+')) AS n_word,
  len(regexp_extract_all(lower(s), '[aeiouyàâäéèêëîïôöùûüœæ]+')) AS n_syl,
  len(list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{M}}]+'), lambda w: w IN ({CLAUSES}))) AS sub_clauses,
  len(regexp_extract_all(s, '[,;:(]')) AS breaks FROM kept),
feat AS (SELECT doc_id, pi, si, s, n_tok, n_word, sub_clauses,
  least(16, 1 + breaks + sub_clauses + CAST(floor(ln(CAST(n_tok AS DOUBLE)) / ln(2e0)) AS INT)) AS depth,
  206.835e0 - 1.015e0 * n_word / 1e0 - 84.6e0 * n_syl / nullif(n_word, 0) AS flesch FROM feats)
"""
LEX = r"""
lw AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM docs),
lc AS (SELECT word, count(*) AS cnt FROM lw GROUP BY word),
lex AS (SELECT word, cnt, log10(cnt * 1e9 / (SELECT sum(cnt) FROM lc)) AS zipf FROM lc)
"""
RATIO = r"""
sw AS (SELECT doc_id, pi, si, unnest(regexp_extract_all(lower(s), '\p{L}+')) AS w FROM kept),
ratio AS (SELECT doc_id, pi, si, CAST(sum(CASE WHEN coalesce(zipf, 0e0) < 4e0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS hard_ratio FROM sw LEFT JOIN lex ON sw.w = lex.word GROUP BY doc_id, pi, si)
"""
SCORE = "100e0 * (0.2e0 * ((n_tok - 5e0) / 75e0) + 0.3e0 * ((depth - 1e0) / 15e0) + 0.4e0 * ((sub_clauses - 0e0) / 5e0) + 0.1e0 * ((hard_ratio - 0e0) / 1e0) - 0.1e0 * ((flesch - 0e0) / 100e0))"
SCORED = f"""scored_ AS (SELECT f.*, coalesce(hard_ratio, 0e0) AS hard_ratio FROM feat f LEFT JOIN ratio USING (doc_id, pi, si)),
final AS (SELECT *, {SCORE} AS score FROM scored_)"""

NOTES = f"n AS (SELECT DISTINCT {SENTENCE}, note_id, text, note_content, note_error, model FROM notes)"
ORDER = """
sp AS (SELECT book_id, idref AS item_id, max(spine_idx) AS spine_idx FROM spine GROUP BY book_id, idref),
mf AS (SELECT book_id, item_id, arg_max(struct_pack(href := href, media_type := media_type), struct_pack(ord := ord, href := href, media_type := media_type)) AS i FROM manifest GROUP BY book_id, item_id),
ro AS (SELECT sp.book_id, spine_idx, sp.item_id, i.href AS href, i.media_type AS media_type FROM sp JOIN mf USING (book_id, item_id))
"""
STEM = r"regexp_replace(split_part(href, '/', -1), '^(.+)\.[^.]*$', '\1')"
SUFFIX = r"regexp_extract(split_part(href, '/', -1), '^.+(\.[^.]*)$', 1)"
FOLDER = r"regexp_extract(href, '^(.*/)[^/]*$', 1)"


def escaped(x: str, quotes: bool = False) -> str:
    out = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace(replace({out}, '\"', '&quot;'), chr(39), '&#x27;')" if quotes else out


# first marks and the parts between them, as lengths that never go below zero
PARSED = f"""
{NOTES},
m AS (SELECT *, strpos(note_content, '分析：') AS a, strpos(note_content, '整体翻译：') AS t, strpos(note_content, '单词解释：') AS w, length(note_content) + 1 AS e FROM n),
p AS (SELECT *,
  CASE WHEN a > 0 THEN nullif({stripped("substr(note_content, a + 3, greatest((CASE WHEN t > 0 THEN t ELSE e END) - a - 3, 0))")}, '') END AS analysis,
  CASE WHEN a > 0 AND t > 0 THEN nullif({stripped("substr(note_content, t + 5, greatest((CASE WHEN w > 0 THEN w ELSE e END) - t - 5, 0))")}, '') END AS translation,
  CASE WHEN a > 0 AND w > 0 THEN nullif({stripped("substr(note_content, w + 5, greatest(e - w - 5, 0))")}, '') END AS word_explanation FROM m)
"""
EXPLANATION = f"""CASE WHEN coalesce(a, 0) > 0 THEN
  coalesce('<span class="analysis-section">' || {escaped("analysis")} || '</span><br/>', '') || coalesce('<span class="translation-section">' || {escaped("translation")} || '</span><br/>', '') ||
  coalesce('<span class="word-explanation-section">' || {escaped("word_explanation")} || '</span>', '') ELSE {escaped("coalesce(note_content, '')")} END"""
PAIR = f"""'<p><span class="original-text">' || {escaped("coalesce(text, '')")} || '</span><span class="explanation">' || {EXPLANATION} || '</span></p>'"""

PAGES = f"""
dp AS (SELECT DISTINCT {CHAPTER}, para_idx, full_text FROM paragraphs),
pages AS (SELECT {CHAPTER}, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>' || book_id || ' ' || CAST(spine_idx AS VARCHAR) ||
  '</title><meta charset="utf-8"></head><body><hr class="top">' || string_agg('<p>' || {escaped("coalesce(full_text, '')")} || '</p>', chr(10) ORDER BY para_idx, full_text) || '</body></html>' AS html FROM dp GROUP BY {CHAPTER})
"""
VOID = r"<(br|hr|input|col|base|meta|area)(\s[^>]*?)\s*/?>"
HEAD = r"(?is)^(?:<\?xml.*?\?>\s*)?(?:<!DOCTYPE.*?>\s*)?"
RANKED = f"""{PAGES},
rp AS (SELECT {CHAPTER}, CAST(row_number() OVER (PARTITION BY {CHAPTER} ORDER BY para_idx, full_text) - 1 AS INT) AS para_idx, full_text FROM dp),
tp AS (SELECT {CHAPTER}, para_idx, {stripped("full_text")} AS text FROM rp WHERE {stripped("full_text")} <> '')
"""
XHTML = "x AS (SELECT * FROM ro WHERE media_type = 'application/xhtml+xml')"

ORACLES: dict[str, str] = {
    "hard_sentences": f"WITH {EN} {SPLIT}, {KEPT}, {FEATS}, {LEX}, {RATIO}, {SCORED} SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY pi) AS INT) AS note_id, pi, si, round(score, 6) AS score, s FROM final WHERE score > 45e0",
    "sentence_split": f"WITH docs AS (SELECT doc_id, text FROM documents), {SPLIT} SELECT doc_id, pi, si, s FROM sents",
    "sentence_prefilter": f"WITH {EN} {SPLIT}, {KEPT} SELECT doc_id, pi, si, s FROM kept",
    "prefilter_reasons": f"WITH {EN} {SPLIT} SELECT CASE WHEN length(s) < 5 THEN 'short' WHEN right(s, 1) NOT IN ({ENDS}) THEN 'no_end_mark' WHEN {ALPHA} <= 3 THEN 'few_words' ELSE 'scored' END AS reason, count(*) AS n FROM sents GROUP BY 1",
    "token_features": f"WITH {EN} {SPLIT}, {KEPT}, {FEATS} SELECT doc_id, pi, si, CAST(n_tok AS BIGINT) AS n_tok, CAST(n_word AS BIGINT) AS n_word, CAST(sub_clauses AS BIGINT) AS sub_clauses, CAST(depth AS BIGINT) AS depth, round(flesch, 6) AS flesch FROM feat",
    "zipf_lexicon": f"WITH {EN} {LEX} SELECT word, cnt, round(zipf, 6) AS zipf FROM lex",
    "rare_word_ratio": rf"""WITH s AS (SELECT DISTINCT {SENTENCE}, text FROM sentences WHERE text IS NOT NULL),
w AS (SELECT {SENTENCE}, text, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM s),
l AS (SELECT lower(word) AS word, max(zipf) AS zipf FROM lexicon GROUP BY 1),
r AS (SELECT {SENTENCE}, CAST(sum(CASE WHEN coalesce(zipf, 0e0) < 4e0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS h FROM w LEFT JOIN l ON w.w = l.word GROUP BY {SENTENCE})
SELECT DISTINCT {SENTENCE}, round(coalesce(h, 0e0), 6) AS hard_ratio FROM (SELECT DISTINCT {SENTENCE} FROM s) LEFT JOIN r USING ({SENTENCE})""",
    "difficulty_score": f"WITH {EN} {SPLIT}, {KEPT}, {FEATS}, {LEX}, {RATIO}, {SCORED} SELECT doc_id, pi, si, round(hard_ratio, 6) AS hard_ratio, round(score, 6) AS score FROM final",
    "score_given_features": f"WITH d AS (SELECT DISTINCT {SENTENCE}, n_tok, depth, sub_clauses, hard_ratio, flesch FROM scored), f AS (SELECT *, {SCORE} AS score FROM d) SELECT {SENTENCE}, round(score, 6) AS score, score > 45e0 AS is_hard FROM f",
    "tree_depth": f"""WITH RECURSIVE sizes AS (SELECT DISTINCT n_tok FROM scored WHERE n_tok > 0),
nodes AS (SELECT n_tok, CAST(unnest(range(1, CAST(n_tok AS BIGINT) + 1)) AS BIGINT) AS k FROM sizes),
walk AS (SELECT n_tok, k, 1 AS depth FROM nodes WHERE k = 1 UNION ALL SELECT nodes.n_tok, nodes.k, walk.depth + 1 FROM walk JOIN nodes ON nodes.n_tok = walk.n_tok AND nodes.k // 2 = walk.k AND nodes.k > 1),
deep AS (SELECT n_tok, max(depth) AS depth FROM walk GROUP BY n_tok)
SELECT DISTINCT {SENTENCE}, n_tok_.depth AS depth FROM (SELECT DISTINCT {SENTENCE}, n_tok FROM scored WHERE n_tok > 0) s JOIN deep n_tok_ ON s.n_tok = n_tok_.n_tok""",
    "note_ids": f"WITH {NOTES} SELECT {SENTENCE}, dense_rank() OVER (PARTITION BY {CHAPTER} ORDER BY para_idx) AS note_id FROM n",
    "note_parse": f"WITH {PARSED} SELECT {SENTENCE}, analysis, translation, word_explanation FROM p",
    "note_errors": f"WITH {NOTES} SELECT {SENTENCE}, coalesce(starts_with(note_content, 'Ollama请求失败: '), false) AS failed FROM n",
    "note_markup": f"WITH {PARSED} SELECT {SENTENCE}, {PAIR} AS html FROM p",
    "note_groups": f"""WITH {PARSED}, q AS (SELECT {CHAPTER}, note_id, sent_idx, {PAIR} AS pair FROM p WHERE note_id IS NOT NULL)
SELECT {CHAPTER}, note_id, '<h3 id="llmnote-' || note_id || '">#' || note_id || ':</h3>' || string_agg(pair, '' ORDER BY sent_idx, pair) AS html FROM q GROUP BY {CHAPTER}, note_id""",
    "run_totals": f"WITH {NOTES} SELECT (SELECT count(*) FROM (SELECT DISTINCT {CHAPTER} FROM n)) AS n_chapters, (SELECT count(*) FROM (SELECT DISTINCT {CHAPTER}, note_id FROM n WHERE note_id IS NOT NULL)) AS n_paragraphs, count(*) AS n_notes, count(*) FILTER (WHERE coalesce(note_error, false)) AS n_failed FROM n",
    "model_lookup": f"WITH d AS (SELECT DISTINCT {SENTENCE}, model FROM notes), m AS (SELECT DISTINCT name, tag, description FROM models) SELECT {SENTENCE}, model, tag, coalesce(description, '未知模型') AS description FROM d LEFT JOIN m ON d.model = m.name",
    "available_models": "SELECT DISTINCT name, tag FROM models",
    "broken_links": f"""WITH {NOTES}, sp AS (SELECT DISTINCT {CHAPTER}, idref AS item_id FROM spine)
SELECT {CHAPTER}, item_id AS target FROM sp ANTI JOIN manifest USING (book_id, item_id) UNION ALL SELECT {CHAPTER}, concat_ws('-', para_idx, sent_idx) FROM n ANTI JOIN sentences USING ({SENTENCE})""",
    "stub_explanations": rf"WITH {EN} {SPLIT}, {KEPT}, {FEATS}, {LEX}, {RATIO}, {SCORED} SELECT doc_id, pi AS para_idx, si AS sent_idx, '分析：全句共' || len(regexp_split_to_array(s, '[\s\x0b]+')) || '词。整体翻译：（' || s || '）。单词解释：' || regexp_extract(s, '\p{{L}}+') AS note_content, false AS note_error FROM final WHERE score > 45e0",
    "chat_messages": f"""WITH {NOTES} SELECT {SENTENCE}, 'system' AS role, '为英文句子写一行中文说明，格式为“分析：…整体翻译：…单词解释：…”。' || chr(10) || chr(10) || '这句话来自：“' || coalesce(nullif(book_id, ''), '未知书籍') || '”' AS content FROM n
UNION ALL SELECT {SENTENCE}, 'user', coalesce(text, '') FROM n""",
    "book_name_default": "SELECT doc_id, coalesce(nullif(book_id, ''), '未知书籍') AS book_name FROM documents",
    "spine_manifest_join": f"WITH {ORDER} SELECT book_id, spine_idx, item_id, href, media_type FROM ro",
    "xhtml_chapters": f"WITH {ORDER} SELECT {CHAPTER}, href, url_decode(href) AS path FROM ro WHERE media_type = 'application/xhtml+xml'",
    "chapter_filter": f"WITH {ORDER}, s AS (SELECT {CHAPTER}, {STEM} AS chapter_name FROM ro) SELECT * FROM s WHERE regexp_matches(chapter_name, 'ch[0-9]*[05]$')",
    "media_types": f"WITH {ORDER} SELECT media_type, count(*) AS n FROM ro GROUP BY media_type",
    "companion_titles": f"WITH {ORDER} SELECT {CHAPTER}, {STEM} AS chapter_name, {FOLDER} || {STEM} || '_ext' || {SUFFIX} AS companion_href, {STEM} || ' 译文参考' AS companion_title, 'item_' || replace({FOLDER} || {STEM} || '_ext' || {SUFFIX}, '.', '_') AS companion_id FROM ro",
    "anchor_links": f"WITH {ORDER}, {NOTES}, i AS (SELECT DISTINCT {CHAPTER}, note_id FROM n WHERE note_id IS NOT NULL) SELECT {CHAPTER}, note_id, {STEM} || '_ext.html#llmnote-' || note_id AS legacy_href, {STEM} || '_ext' || {SUFFIX} || '#llmnote-' || note_id AS href FROM i JOIN ro USING ({CHAPTER})",
    "ncx_paths": "SELECT book_id, arg_min(href, struct_pack(ord := ord, href := href)) AS href FROM manifest WHERE item_id = 'ncx' GROUP BY book_id",
    "contains_join": f"WITH {ORDER}, i AS (SELECT DISTINCT book_id, {STEM} AS item_id FROM ro) SELECT i.book_id, i.item_id, min(ro.spine_idx) AS nav_idx FROM i JOIN ro ON i.book_id = ro.book_id AND contains(ro.href, i.item_id) GROUP BY 1, 2",
    "exact_nav_join": f"WITH {ORDER}, i AS (SELECT DISTINCT book_id, {STEM} AS item_id FROM ro), v AS (SELECT book_id, spine_idx, {STEM} AS item_id FROM ro) SELECT i.book_id, i.item_id, min(v.spine_idx) AS nav_idx FROM i JOIN v USING (book_id, item_id) GROUP BY 1, 2",
    "renumber_after_insert": f"""WITH {ORDER}, {NOTES}, i AS (SELECT DISTINCT {CHAPTER} FROM n WHERE note_id IS NOT NULL),
b AS (SELECT {CHAPTER}, item_id, false AS is_added FROM ro UNION ALL SELECT {CHAPTER}, 'item_' || replace({FOLDER} || {STEM} || '_ext' || {SUFFIX}, '.', '_'), true FROM ro JOIN i USING ({CHAPTER}))
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY spine_idx, is_added) - 1 AS new_idx, item_id, is_added FROM b""",
    "play_orders": f"""WITH {ORDER}, {NOTES}, i AS (SELECT DISTINCT {CHAPTER} FROM n WHERE note_id IS NOT NULL), c AS (SELECT book_id, count(*) AS c FROM ro GROUP BY book_id)
SELECT {CHAPTER}, c + row_number() OVER (PARTITION BY book_id ORDER BY spine_idx) AS play_order FROM i JOIN (SELECT {CHAPTER} FROM ro) USING ({CHAPTER}) JOIN c USING (book_id)""",
    "manifest_spine_order": f"WITH {ORDER} SELECT mf.book_id, mf.item_id, row_number() OVER (PARTITION BY mf.book_id ORDER BY spine_idx ASC NULLS LAST, mf.item_id) AS place FROM mf LEFT JOIN sp USING (book_id, item_id)",
    "last_spine_item": f"WITH {ORDER} SELECT book_id, arg_max(item_id, spine_idx) AS item_id FROM ro GROUP BY book_id",
    "positional_zip": f"""WITH {NOTES}, l AS (SELECT *, row_number() OVER (PARTITION BY {CHAPTER} ORDER BY para_idx, sent_idx) AS pos FROM (SELECT DISTINCT {SENTENCE} FROM sentences)),
r AS (SELECT {CHAPTER}, note_content, row_number() OVER (PARTITION BY {CHAPTER} ORDER BY para_idx, sent_idx) AS pos FROM n)
SELECT {SENTENCE}, pos, note_content FROM l JOIN r USING ({CHAPTER}, pos) WHERE note_content IS NOT NULL""",
    "label_merge": "SELECT n_nationkey, CASE WHEN r_name IS NOT DISTINCT FROM n_name THEN r_name ELSE concat_ws(' - ', r_name, n_name) END AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "void_tags_xml": rf"WITH {PAGES} SELECT {CHAPTER}, md5(regexp_replace(html, '{VOID}', '<\1\2 />', 'g')) AS html FROM pages",
    "void_tags_html": rf"WITH {PAGES} SELECT {CHAPTER}, md5(regexp_replace(regexp_replace(html, '{VOID}', '<\1\2 />', 'g'), '{VOID}', '<\1\2>', 'g')) AS html FROM pages",
    "doc_head_strip": f"WITH {PAGES} SELECT {CHAPTER}, regexp_extract(html, '{HEAD}') AS head, md5(regexp_replace(html, '{HEAD}', '')) AS body FROM pages",
    "page_title": f"WITH {PAGES} SELECT {CHAPTER}, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title FROM pages",
    "html_escape": f"SELECT doc_id, {escaped('text', True)} AS escaped FROM documents",
    "page_paragraphs": f"WITH {RANKED} SELECT {CHAPTER}, para_idx, text FROM tp",
    "fragment_counts": f"WITH {RANKED} SELECT {CHAPTER}, 2 + count(*) + count(*) - 1 - (count(*) - 1) AS n FROM rp GROUP BY {CHAPTER}",
    "page_fragments": f"""WITH {RANKED} SELECT {CHAPTER}, CAST(2 + para_idx AS INT) AS frag_idx, 'WHOLE_DOM' AS position, coalesce(full_text, '') || CASE WHEN para_idx < max(para_idx) OVER (PARTITION BY {CHAPTER}) THEN chr(10) ELSE '' END AS text FROM rp""",
    "page_rewrite": f"""WITH {RANKED} SELECT {CHAPTER}, CAST(2 * para_idx AS INT) AS para_idx, text FROM tp UNION ALL SELECT {CHAPTER}, CAST(2 * para_idx + 1 AS INT), 't' || (para_idx + 3) FROM rp""",
    "epub_annotated": f"""WITH {ORDER}, {XHTML}, {RANKED},
docs AS (SELECT book_id || '|' || spine_idx || '|' || para_idx AS doc_id, text FROM tp JOIN (SELECT {CHAPTER} FROM x) USING ({CHAPTER})),
{SPLIT}, {KEPT}, {FEATS}, lex AS (SELECT lower(word) AS word, max(zipf) AS zipf FROM lexicon GROUP BY 1), {RATIO}, {SCORED},
hard AS (SELECT DISTINCT doc_id, split_part(doc_id, '|', 1) AS book_id, split_part(doc_id, '|', 2) AS chapter FROM final WHERE score > 45e0),
c AS (SELECT book_id, count(*) AS n, count(DISTINCT chapter) AS added FROM hard GROUP BY book_id),
s AS (SELECT book_id, count(*) AS n FROM (SELECT DISTINCT book_id, spine_idx, idref FROM spine) GROUP BY book_id),
v AS (SELECT book_id, count(*) AS n FROM ro GROUP BY book_id), b AS (SELECT DISTINCT book_id FROM manifest)
SELECT b.book_id, coalesce(s.n, 0) + coalesce(added, 0) AS n_spine, coalesce(v.n, 0) + coalesce(added, 0) AS n_nav, coalesce(c.n, 0) AS n_links, coalesce(c.n, 0) AS n_targets FROM b LEFT JOIN s USING (book_id) LEFT JOIN v USING (book_id) LEFT JOIN c USING (book_id)""",
    "anchor_insert": f"""WITH {ORDER}, {NOTES}, {RANKED}, i AS (SELECT DISTINCT {CHAPTER}, para_idx, note_id FROM n WHERE note_id IS NOT NULL),
c AS (SELECT {CHAPTER}, max(para_idx) AS top FROM rp GROUP BY {CHAPTER})
SELECT {CHAPTER}, {STEM} || '_ext.html#llmnote-' || note_id AS href FROM (SELECT {CHAPTER}, para_idx, arg_max(note_id, note_id) AS note_id FROM i GROUP BY {CHAPTER}, para_idx) JOIN ro USING ({CHAPTER}) JOIN c USING ({CHAPTER}) WHERE para_idx <= top""",
    "companion_page_notes": f"""WITH {NOTES}, {PAGES}, c AS (SELECT DISTINCT {CHAPTER} FROM dp)
SELECT {CHAPTER}, CAST(count(DISTINCT note_id) AS INT) AS n_headings, CAST(count(*) AS INT) AS n_pairs, 1 AS n_titles FROM n JOIN c USING ({CHAPTER}) WHERE note_id IS NOT NULL GROUP BY {CHAPTER}""",
    "epub_catalogue": f"""WITH {ORDER}, {XHTML}, s AS (SELECT book_id, count(*) AS n_spine FROM (SELECT DISTINCT book_id, spine_idx, idref FROM spine) GROUP BY book_id),
v AS (SELECT book_id, count(*) AS n_nav FROM ro GROUP BY book_id),
b AS (SELECT book_id, CASE WHEN bool_or(item_id = 'ncx') THEN arg_max(href, ord) FILTER (WHERE item_id = 'ncx') END AS ncx FROM manifest GROUP BY book_id),
t AS (SELECT DISTINCT book_id FROM x)
SELECT b.book_id, CASE WHEN t.book_id IS NOT NULL THEN 'Book & ' || b.book_id END AS title, 'OEBPS/' || ncx AS ncx_path, coalesce(n_spine, 0) AS n_spine, coalesce(n_nav, 0) AS n_nav FROM b LEFT JOIN s USING (book_id) LEFT JOIN v USING (book_id) LEFT JOIN t USING (book_id)""",
    "epub_roundtrip": f"""WITH {ORDER}, {XHTML}, {RANKED}, h AS (SELECT book_id, spine_idx FROM x)
SELECT {CHAPTER}, count(*) AS n, sum(length(text)) AS n_chars FROM tp JOIN h USING ({CHAPTER}) GROUP BY {CHAPTER}""",
    "nav_relabelled": f"""WITH {ORDER}, v AS (SELECT book_id, item_id, row_number() OVER (PARTITION BY book_id ORDER BY spine_idx) - 1 AS k FROM ro)
SELECT book_id, CAST(k AS INT) AS nav_idx, CASE WHEN k % 2 = 1 OR upper(item_id) = item_id THEN item_id ELSE item_id || ' - ' || upper(item_id) END AS label FROM v""",
    "metadata_rewritten": f"WITH {ORDER}, {XHTML}, t AS (SELECT DISTINCT book_id FROM x) SELECT DISTINCT manifest.book_id, CASE WHEN t.book_id IS NOT NULL THEN 'A <new> title' END AS title, CASE WHEN t.book_id IS NOT NULL THEN 'A. Writer; B. <Writer>' ELSE '' END AS authors, CASE WHEN t.book_id IS NOT NULL THEN 'First & Co.; ' || t.book_id || '; Third' ELSE '' END AS authors_before FROM manifest LEFT JOIN t ON manifest.book_id = t.book_id",
}

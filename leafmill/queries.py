"""One query for each job, over the given tables or pages derived from them, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import clean_text, is_title_line, word_count
from .operators import checks, conversations as conv, lines as ln, passages as ps, segments as sg, structure as st, vectors as vec
from .plans.corpus import answer_questions, body_of, build_records, corpus_report
from .profiles import GUIDELINE, STANDARD, TARGET_WORDS
from .sources import tables
from .sources.pages import derived_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _longs(df: DataFrame) -> DataFrame:
    """Whole numbers all as long, so that both engines agree on types."""
    return df.select([F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint") else F.col(f"`{n}`") for n, t in df.dtypes])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf: _longs(f(spark, sf))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- SQL layers: the derived pages, their lines, headings and chunks -------------------------------------------------

_S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_NORM = rf"regexp_replace(regexp_replace(X, '{_S}+', ' ', 'g'), '^ | $', '', 'g')"
_LABEL = r"^Ref\.\s*No\.\s*:\s*(S17|G3)\s+(.+)$"
_WORDS = "len(regexp_extract_all(X, '[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*'))"
_HEADER = "(starts_with(line, 'BASELINE IT SECURITY POLICY') or starts_with(line, 'IT SECURITY GUIDELINES'))"

SQL_PAGES = """
with l as (select doc_id, unnest(string_split(text, chr(10))) ln, unnest(range(len(string_split(text, chr(10))))) i from documents where text is not null),
m as (select doc_id, i,
  case when i % 24 = 0 then (i // 24 + 1)::varchar || '. SECTION ' || substr('ABCDEFGH', (i // 24 + 1)::int, 1) || 'X' || chr(10) else '' end ||
  case when i % 8 = 0 then (i // 24 + 1)::varchar || '.' || ((i % 24) // 8 + 1)::varchar || '. Topic Heading' || chr(10) else '' end ||
  case when i % 4 = 1 then (i // 24 + 1)::varchar || '.' || ((i % 24) // 8 + 1)::varchar || '.' || ((i % 8) // 4 + 1)::varchar || ' '
       when i % 5 = 2 then '• ' when i % 7 = 3 then 'a) ' else '' end || ln || case when i % 3 = 2 then chr(10) else '' end s from l),
p as (select doc_id, i // 12 + 2 pdf_page, string_agg(s, chr(10) order by i) body from m group by 1, 2),
pages as (select doc_id document, 1 pdf_page, 'BASELINE IT SECURITY POLICY CONTENTS' || chr(10) || 'Ref. No. : S17 iii-1' || chr(10) || '1. SECTION AX' || chr(10) || 'Contents text' page_text from (select distinct doc_id from p)
  union all select doc_id, pdf_page, 'BASELINE IT SECURITY POLICY BODY' || chr(10) || 'Ref. No. : S17 ' || (pdf_page - 1)::varchar || chr(10) || body from p)
"""
SQL_LINES = SQL_PAGES + f""",
cut as (select document, pdf_page, string_split(page_text, chr(10)) ls from pages),
raws as (select document, pdf_page, unnest(case when ls[-1] = '' then ls[1:len(ls)-1] else ls end) raw, unnest(range(case when ls[-1] = '' then len(ls) - 1 else len(ls) end)) line_no from cut),
all_lines as (select document, pdf_page, line_no, {_NORM.replace('X', 'raw')} line from raws),
marked as (select *, regexp_matches(line, '{_LABEL}') is_label, min(case when regexp_matches(line, '{_LABEL}') then line_no end) over w label_at, arg_min(line, line_no) filter (line <> '') over w first_text from all_lines window w as (partition by document, pdf_page)),
unheaded as (select document, pdf_page, line_no, line, is_label from marked
  where not ({_HEADER.replace('line,', 'first_text,')} and line_no < coalesce(label_at, 0)) and not {_HEADER}),
counted as (select *, sum((line = '')::int) over (partition by document, pdf_page order by line_no) blanks,
  arg_max(case when is_label then regexp_extract(line, '{_LABEL}', 2) end, case when is_label then line_no end) over (partition by document, pdf_page) printed_page from unheaded),
kept as (select document, pdf_page, line_no, line, coalesce(blanks > lag(blanks) over (partition by document, pdf_page order by line_no), false) blank_before, printed_page
  from counted where line <> '' and not is_label),
body as (select * from (select *, min(case when printed_page = '1' then pdf_page end) over (partition by document) first_page from kept) where pdf_page >= first_page)
"""
_TOP, _SUB, _CONTROL, _APPENDIX = r"^(\d+)\.?\s+([A-Z][A-Z &,/\-]+)$", r"^(\d+\.\d+)\.?\s+([A-Z].+)$", r"^(\d+\.\d+\.\d+)\.?\s+(.+)$", r"^APPENDIX ([A-Z])\s+(.+)$"
SQL_HEADS = SQL_LINES + f""",
flagged as (select *, regexp_matches(line, '{_TOP}') or regexp_matches(line, '{_APPENDIX}') head,
  regexp_matches(line, '\\p{{Lu}}') and not regexp_matches(line, '\\p{{Ll}}') and not blank_before and not regexp_matches(line, '{_TOP}') and not regexp_matches(line, '{_APPENDIX}')
  and not regexp_matches(line, '{_SUB}') and not regexp_matches(line, '{_CONTROL}') goes_on from body),
islands as (select *, sum((not goes_on)::int) over (partition by document, pdf_page order by line_no) island from flagged),
tops as (select *, arg_min(head, line_no) over w under_head, string_agg(case when goes_on then line end, ' ') over (partition by document, pdf_page, island order by line_no rows between unbounded preceding and unbounded following) rest
  from islands window w as (partition by document, pdf_page, island)),
titled as (select document, pdf_page, line_no, line, blank_before, printed_page,
  case when head then case when regexp_matches(line, '{_APPENDIX}') then 'APPENDIX-' || regexp_extract(line, '{_APPENDIX}', 1) else regexp_extract(line, '{_TOP}', 1) end end top_section,
  case when head then concat_ws(' ', case when regexp_matches(line, '{_APPENDIX}') then regexp_extract(line, '{_APPENDIX}', 2) else regexp_extract(line, '{_TOP}', 2) end, rest) end top_title
  from tops where not (goes_on and under_head)),
seen as (select *, last_value(top_section ignore nulls) over d cur_top, last_value(top_title ignore nulls) over d cur_top_title, count(top_section) over d top_seq from titled window d as (partition by document order by pdf_page, line_no)),
classed as (select *, case when top_section is not null then 'top' when regexp_matches(line, '{_CONTROL}') and split_part(line, '.', 1) = cur_top then 'control'
  when regexp_matches(line, '{_SUB}') and split_part(line, '.', 1) = cur_top then 'subsection' else 'body' end line_class from seen),
heads as (select *, last_value(case when line_class = 'subsection' then regexp_extract(line, '{_SUB}', 1) end ignore nulls) over t cur_sub, last_value(case when line_class = 'subsection' then regexp_extract(line, '{_SUB}', 2) end ignore nulls) over t cur_sub_title,
  case line_class when 'top' then top_section when 'control' then regexp_extract(line, '{_CONTROL}', 1) when 'subsection' then regexp_extract(line, '{_SUB}', 1) end number,
  case line_class when 'top' then top_title when 'control' then regexp_extract(line, '{_CONTROL}', 2) when 'subsection' then regexp_extract(line, '{_SUB}', 2) end title
  from classed window t as (partition by document, top_seq order by pdf_page, line_no)),
context as (select *, concat_ws(' > ', cur_top || '. ' || cur_top_title, cur_sub || '. ' || cur_sub_title) parents from heads)
"""
SQL_CHUNKS = SQL_HEADS + f""",
segged as (select *, sum((line_class <> 'body')::int) over (partition by document order by pdf_page, line_no) seg from context where cur_top is not null),
chunks as (select document, seg, case when max((line_class = 'control')::int) = 1 then 'numbered_clause' else 'overview' end kind,
  coalesce(max(case when line_class = 'control' then number end), arg_min(coalesce(cur_sub, cur_top), (pdf_page, line_no))) section, arg_min(parents, (pdf_page, line_no)) parents, arg_min(pdf_page, (pdf_page, line_no)) pdf_page_start,
  arg_min(coalesce(printed_page, ''), (pdf_page, line_no)) printed_page_start, count(*) n_lines,
  {_NORM.replace('X', "replace(string_agg(case when line_class = 'control' then title else line end, ' ' order by pdf_page, line_no), chr(61599), '•')")} text
  from segged where line_class in ('control', 'body') group by 1, 2),
named as (select *, document::varchar || '-v8.2-' || section || case when kind = 'overview' then '-overview' else '-clause' end base_id from chunks where text <> ''),
ids as (select *, base_id || case when row_number() over (partition by document, base_id order by seg) = 1 then '' else '-' || (row_number() over (partition by document, base_id order by seg))::varchar end id from named)
"""


def _packed_sql(items: str, joins: str, name: str) -> str:
    """A fold over items (text, words, kind), as one list of packs."""
    item = "struct(text varchar, words bigint, kind varchar)[]"
    start = f"list_transform({items}, lambda i: {{'done': []::{item}, 'text': i.text, 'words': i.words, 'kind': case when i.kind = '{joins}' then '{name}' else i.kind end}})"
    grown = f"{{'done': a.done, 'text': a.text || ' ' || x.text, 'words': a.words + x.words, 'kind': '{name}'}}"
    closed = "{'done': a.done || [{'text': a.text, 'words': a.words, 'kind': a.kind}], 'text': x.text, 'words': x.words, 'kind': x.kind}"
    return f"list_reduce({start}, lambda a, x: case when a.kind = '{name}' and x.kind = '{name}' and a.words + x.words <= 220 then {grown} else {closed} end)"


def _pieces_sql(source: str, key: str) -> str:
    """From rows (key, text, words, kind) to lists of pieces: whole, marked for review, or packed sentences."""
    item = lambda x, kind: f"{{'text': {x}, 'words': {_WORDS.replace('X', x)}::bigint, 'kind': '{kind}'}}"
    strip = lambda x: f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"
    words = "(?:^[^A-Za-z0-9]*)?(?:[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*[^A-Za-z0-9]*){1,220}"
    return f"""cut_sentences as (select *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_S}+([A-Z0-9])', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda x: {strip('x')}), lambda x: x <> '') sentences from {source} where words > 220),
sentence_lists as (select *, flatten(list_transform(sentences, lambda x: case when {_WORDS.replace('X', 'x')} > 300 then list_transform(regexp_extract_all(x, '{words}'), lambda y: {item(strip('y'), 'word_boundary')}) else [{item('x', 'sentence')}] end)) items from cut_sentences),
folded as (select *, case when len(items) > 1 or words > 300 then {_packed_sql('items', 'sentence', 'sentence_boundary')} end f from sentence_lists),
piece_lists as (select {key}, case when f is null then [{{'text': text, 'words': words, 'kind': kind || '_needs_review'}}] else f.done || [{{'text': f.text, 'words': f.words, 'kind': f.kind}}] end pieces from folded
  union all select {key}, [{{'text': text, 'words': words, 'kind': kind}}] from {source} where words <= 220)
"""


_TITLE = r"""(line <> '' and not regexp_matches(line, '[.;:,]') and not contains(lower(line), 'http') and length(line) <= 90 and len(regexp_extract_all(line, '[A-Za-z]+')) between 2 and 12
and len(list_filter(regexp_extract_all(line, '[A-Za-z]+'), lambda t: lower(t) in ('shall', 'should', 'must', 'will'))) = 0
and 10 * len(list_filter(regexp_extract_all(line, '[A-Za-z]+'), lambda t: regexp_matches(t, '^[A-Z]') or lower(t) in ('and', 'of', 'the', 'in', 'for', 'to', 'on', 'with', 'by', '&'))) >= 8 * len(regexp_extract_all(line, '[A-Za-z]+')))"""
_PART = "{{'text': {}, 'starts': {}, 'kind': {}}}"
SQL_UNITS = SQL_CHUNKS + rf""",
sized as (select *, {_WORDS.replace('X', 'text')}::bigint words from ids),
chunk_lines as (select z.id, pdf_page, line_no, case when line_class = 'control' then title else line end line, blank_before and row_number() over (partition by z.id order by pdf_page, line_no) > 1 gap
  from segged join (select id, document, seg from sized where words > 220) z using (document, seg) where line_class in ('control', 'body')),
bulleted as (select *, string_split(replace(line, chr(61599), '•'), '•') bits from chunk_lines),
fragments as (select id, pdf_page, line_no, case when gap then [{_PART.format("''", 'true', "'paragraph'")}] else [] end ||
  case when len(bits) > 1 then [{_PART.format('trim(bits[1])', 'false', 'null::varchar')}, {_PART.format("''", 'true', 'null::varchar')}] || list_transform(list_filter(bits[2:], lambda b: trim(b) <> ''), lambda b: {_PART.format("'• ' || trim(b)", 'true', "'bullet_item'")})
  when regexp_matches(line, '(?i)^(?:[a-z]\)|\([a-z]\)|\d+\.)\s+') then [{_PART.format('line', 'true', "'enumerated_item'")}]
  when {_TITLE} then [{_PART.format('line', 'true', "'internal_heading'")}] else [{_PART.format('line', 'false', 'null::varchar')}] end parts from bulleted),
parts as (select id, pdf_page, line_no, unnest(parts) p, unnest(range(len(parts))) j from fragments),
units_of as (select *, sum(p.starts::int) over w unit_no, last_value(p.kind ignore nulls) over w so_far from parts window w as (partition by id order by pdf_page, line_no, j)),
unit_texts as (select id, unit_no, {_NORM.replace('X', "replace(string_agg(case when p.text <> '' then p.text end, ' ' order by pdf_page, line_no, j), chr(61599), '•')")} text, coalesce(arg_max(so_far, (pdf_page, line_no, j)), 'paragraph') kind from units_of group by 1, 2),
units as (select id, row_number() over (partition by id order by unit_no) - 1 unit, kind, {_WORDS.replace('X', 'text')}::bigint words, text from unit_texts where text <> ''),
unit_lists as (select id, list({{'text': text, 'words': words, 'kind': kind}} order by unit) us from units group by 1),
merged as (select id, case when len(us) > 1 and us[1].kind = 'internal_heading' and us[1].words <= 12 then [{{'text': us[1].text || ' ' || us[2].text, 'words': us[1].words + us[2].words, 'kind': us[2].kind}}] || us[3:] else us end us from unit_lists),
pack_folds as (select id, {_packed_sql('us', 'paragraph', 'paragraph_group')} f from merged),
packs as (select id, unnest(l) p, unnest(range(len(l))) pack from (select id, f.done || [{{'text': f.text, 'words': f.words, 'kind': f.kind}}] l from pack_folds))
"""
SQL_RECORDS = SQL_UNITS + f""",
passages_in as (select id chunk, pack, p.text as text, p.words as words, p.kind kind from packs union all select id, 0, text, words, 'unchanged' from sized where words <= 220),
{_pieces_sql('passages_in', 'chunk, pack')},
pieces as (select chunk, pack, unnest(pieces) p, unnest(range(len(pieces))) piece from piece_lists),
numbered as (select chunk, p, row_number() over (partition by chunk order by pack, piece) part_number, count(*) over (partition by chunk) part_count from pieces),
made as (select id || '-part-' || case when part_number < 10 then '0' else '' end || part_number::varchar id, 'Section: ' || section || chr(10) || 'Parent sections: ' || parents || chr(10) || 'Text: ' || p.text as text, document::varchar document, '8.2' as version, 'en' as "language", section,
  parents parent_titles, id parent_chunk_id, s.kind source_kind, p.kind split_method, part_number, part_count, pdf_page_start::bigint pdf_page_start, printed_page_start, p.words word_count, 'documents' source_file, seg, s.text whole, p.text body
  from numbered join sized s on chunk = id),
records as (select *, sha256(text) text_sha256 from made)
"""
_BARE = rf"regexp_replace(X, '{_S}|[•\x{{f09f}}]', '', 'g')"

_LETTER, _LEADER = r"^\(([a-z])\)\s+(.+)$", r"\s*\.{2,}.*$"
SQL_LETTERED_PAGES = (
    SQL_HEADS.replace("S17 ", "G3 ")
    .replace(
        "(i // 24 + 1)::varchar || '.' || ((i % 24) // 8 + 1)::varchar || '.' || ((i % 8) // 4 + 1)::varchar || ' '",
        "'(' || substr('ab', ((i % 8) // 4 + 1)::int, 1) || ') Common' || chr(10) || 'Topic Title' || chr(10)",
    )
    .replace(
        "'Contents text' page_text",
        "'Contents text' || chr(10) || array_to_string(list_transform([1, 2, 3], lambda k: '1.' || k::varchar || '. Topic Heading' || chr(10) || '(a) Common' || chr(10) || 'Topic Title ..... 3' || chr(10) || '(b) Common Topic Title .... 4'), chr(10)) page_text",
    )
)
SQL_TOC = SQL_LETTERED_PAGES + rf""",
toc_subs as (select *, regexp_matches(line, '{_SUB}') is_sub, last_value(case when regexp_matches(line, '{_SUB}') then regexp_extract(line, '{_SUB}', 1) end ignore nulls) over (partition by document order by pdf_page, line_no) sub from kept where starts_with(printed_page, 'iii-')),
toc_letters as (select *, case when not is_sub and sub is not null and regexp_matches(line, '{_LETTER}') then regexp_extract(line, '{_LETTER}', 1) end letter, regexp_matches(line, '{_LEADER}') and not is_sub leads from toc_subs),
toc_entries as (select *, sum((letter is not null or is_sub)::int) over (partition by document order by pdf_page, line_no) entry from toc_letters),
toc_open as (select *, coalesce(sum(leads::int) over (partition by document, entry order by pdf_page, line_no rows between unbounded preceding and 1 preceding), 0) ended,
  trim(regexp_replace(case when letter is not null then regexp_extract(line, '{_LETTER}', 2) else line end, '{_LEADER}', '')) part from toc_entries),
toc_whole as (select document, entry, max(sub) || '(' || max(letter) || ')' key, {_NORM.replace('X', "replace(string_agg(part, ' ' order by pdf_page, line_no), chr(61599), '•')")} toc_title from toc_open where ended = 0 group by 1, 2 having max(letter) is not null and max(leads::int) = 1),
toc as (select document, key, arg_max(toc_title, entry) toc_title from toc_whole group by 1, 2)
"""
SQL_LETTERED = SQL_TOC + rf""",
keyed as (select *, case when line_class = 'body' and cur_sub is not null and regexp_matches(line, '{_LETTER}') then cur_sub || '(' || regexp_extract(line, '{_LETTER}', 1) || ')' end key, trim(regexp_extract(line, '{_LETTER}', 2)) own,
  row_number() over p spot, sum(blank_before::int) over p paragraph from heads window p as (partition by document, pdf_page order by line_no)),
looked as (select k.*, toc_title, key is not null and case when d.document is null then {_TITLE.replace('line', 'own')} else toc_title is not null and (starts_with(lower(toc_title), lower(own)) or {_TITLE.replace('line', 'own')}) end is_letter
  from keyed k left join toc using (document, key) left join (select distinct document from toc) d on d.document = k.document),
ahead as (select h.document, h.pdf_page, h.spot, l.spot - h.spot taken, h.toc_title, h.own || ' ' || string_agg(l.line, ' ') over (partition by h.document, h.pdf_page, h.spot order by l.spot) title
  from looked h join keyed l on l.document = h.document and l.pdf_page = h.pdf_page and l.paragraph = h.paragraph and l.spot > h.spot where h.is_letter and h.toc_title is not null),
wrapped as (select document, pdf_page, spot, max(taken) taken, arg_max(title, taken) title from ahead where starts_with(lower(toc_title), lower(title)) group by 1, 2, 3),
covering as (select l.*, coalesce(w.title, own) full_title, max(case when is_letter then l.spot + coalesce(taken, 0) end) over (partition by l.document, l.pdf_page order by l.spot rows between unbounded preceding and 1 preceding) covers from looked l left join wrapped w on w.document = l.document and w.pdf_page = l.pdf_page and w.spot = l.spot),
lettered as (select * from covering where coalesce(covers, 0) < spot)
"""


def _body(spark: SparkSession, sf: str) -> DataFrame:
    return body_of(derived_pages(spark, sf))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return st.structural_chunks(_body(spark, sf))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return build_records(derived_pages(spark, sf))


@query(SQL_PAGES + "select document, pdf_page::bigint pdf_page, length(page_text)::bigint n_chars, md5(page_text) page_md5 from pages")
def read_pages(spark: SparkSession, sf: str) -> DataFrame:
    return derived_pages(spark, sf).select("document", "pdf_page", F.length("page_text").alias("n_chars"), F.md5("page_text").alias("page_md5"))


@query(SQL_LINES + "select document, pdf_page::bigint pdf_page, line_no::bigint line_no, line from all_lines")
def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ln.page_lines(derived_pages(spark, sf))


@query(SQL_LINES + "select document, pdf_page::bigint pdf_page, line_no::bigint line_no, line from unheaded")
def strip_running_headers(spark: SparkSession, sf: str) -> DataFrame:
    return ln.without_header_block(derived_pages(spark, sf))


@query(SQL_LINES + f"select document, pdf_page::bigint pdf_page, arg_max(regexp_extract(line, '{_LABEL}', 2), line_no) printed_page, arg_max(regexp_extract(line, '{_LABEL}', 1), line_no) named from unheaded where is_label group by 1, 2")
def page_labels(spark: SparkSession, sf: str) -> DataFrame:
    return ln.page_labels(ln.without_header_block(derived_pages(spark, sf))).select("document", "pdf_page", "printed_page", F.array_join("names", ",").alias("named"))


@query(SQL_LINES + "select document, pdf_page::bigint pdf_page, line_no::bigint line_no, line, blank_before from kept")
def paragraph_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return ln.kept_lines(derived_pages(spark, sf)).drop("printed_page")


@query(SQL_LINES + "select document, pdf_page::bigint pdf_page, count(*) n_lines from body group by 1, 2")
def body_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _body(spark, sf).groupBy("document", "pdf_page").agg(F.count("*").alias("n_lines"))


@query(SQL_HEADS + "select document, pdf_page::bigint pdf_page, line_no::bigint line_no, line_class, number, title from heads where line_class <> 'body'")
def classify_headings(spark: SparkSession, sf: str) -> DataFrame:
    return st.classified(_body(spark, sf)).where("line_class <> 'body'").select("document", "pdf_page", "line_no", "line_class", "number", "title")


@query(
    SQL_LINES
    + r"""select document, pdf_page::bigint pdf_page, line_no::bigint line_no, line from
(select *, regexp_extract_all(line, '[A-Za-z]+') ts from body) where line <> '' and not regexp_matches(line, '[.;:,]') and not contains(lower(line), 'http') and length(line) <= 90 and len(ts) between 2 and 12
and len(list_filter(ts, lambda t: lower(t) in ('shall', 'should', 'must', 'will'))) = 0
and 10 * len(list_filter(ts, lambda t: regexp_matches(t, '^[A-Z]') or lower(t) in ('and', 'of', 'the', 'in', 'for', 'to', 'on', 'with', 'by', '&'))) >= 8 * len(ts)"""
)
def title_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _body(spark, sf).where(is_title_line(F.col("line"))).select("document", "pdf_page", "line_no", "line")


@query(SQL_HEADS + "select document, pdf_page::bigint pdf_page, line_no::bigint line_no, top_section, top_title from titled where top_section is not null")
def wrapped_titles(spark: SparkSession, sf: str) -> DataFrame:
    return st.wrapped_titles(_body(spark, sf)).where("top_section is not null").select("document", "pdf_page", "line_no", "top_section", "top_title")


@query(SQL_HEADS + "select document, pdf_page::bigint pdf_page, line_no::bigint line_no, cur_top, cur_sub, parents from context")
def heading_context(spark: SparkSession, sf: str) -> DataFrame:
    return st.classified(_body(spark, sf)).select("document", "pdf_page", "line_no", "cur_top", "cur_sub", F.array_join("parent_titles", " > ").alias("parents"))


@query(SQL_CHUNKS + "select document, seg::bigint seg, kind, section, parents, pdf_page_start::bigint pdf_page_start, printed_page_start, n_lines, md5(text) text_md5 from ids")
def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = _chunks(spark, sf)
    return d.select("document", "seg", "kind", "section", F.array_join("parent_titles", " > ").alias("parents"), "pdf_page_start", "printed_page_start", F.size("lines").cast("long").alias("n_lines"), F.md5(ps.chunk_text(F.col("lines"))).alias("text_md5"))


#: All pages of a source's documents, as one document.
SQL_MERGED = SQL_CHUNKS.replace("pages as (", "own_pages as (", 1).replace(
    ",\ncut as (", ",\npages as (select source document, p.document * 1000 + pdf_page pdf_page, page_text from own_pages p join documents d on d.doc_id = p.document),\ncut as (", 1
)


@query(SQL_MERGED + "select document, seg::bigint seg, id, kind, section, parents, pdf_page_start::bigint pdf_page_start, printed_page_start, n_lines, md5(text) text_md5 from ids")
def large_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of few documents of very many pages: the pages of each source's documents as one."""
    of = read(spark, sf, "documents").select(F.col("doc_id").alias("document"), "source")
    pages = derived_pages(spark, sf).join(of, "document").select(F.col("source").alias("document"), (F.col("document") * 1000 + F.col("pdf_page")).cast("int").alias("pdf_page"), "page_text")
    d = sg.segmented_chunks(pages)
    return d.select("document", "seg", "id", "kind", "section", F.array_join("parent_titles", " > ").alias("parents"), "pdf_page_start", "printed_page_start", F.size("lines").cast("long").alias("n_lines"), F.md5(ps.chunk_text(F.col("lines"))).alias("text_md5"))


@query(SQL_CHUNKS + "select document, seg::bigint seg, id from ids")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("document", "seg", "id")


@query(SQL_TOC + "select document, key, toc_title from toc")
def toc_titles(spark: SparkSession, sf: str) -> DataFrame:
    return st.toc_titles(ln.kept_lines(derived_pages(spark, sf, GUIDELINE, contents=True), GUIDELINE), GUIDELINE)


@query(SQL_LETTERED + "select document, pdf_page::bigint pdf_page, line_no::bigint line_no, key number, full_title title from lettered where is_letter")
def lettered_headings(spark: SparkSession, sf: str) -> DataFrame:
    kept = ln.kept_lines(derived_pages(spark, sf, GUIDELINE, contents=True), GUIDELINE)
    found = st.classified(ln.body_lines(kept, GUIDELINE), GUIDELINE, st.toc_titles(kept, GUIDELINE))
    return found.where("line_class = 'letter'").select("document", "pdf_page", "line_no", "number", "title")


@query(f"select doc_id, md5({_NORM.replace('X', chr(10).join(['replace(text, chr(61599), chr(8226))']))}) clean_md5 from documents")
def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.md5(clean_text(F.col("text"))).alias("clean_md5"))


@query(f"select doc_id, {_WORDS.replace('X', 'text')}::bigint words from documents")
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", word_count(F.col("text")).alias("words"))


@query(SQL_CHUNKS + f"select id, {_WORDS.replace('X', 'text')}::bigint words from ids where {_WORDS.replace('X', 'text')} > 220")
def oversized_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ps.sized(_chunks(spark, sf)).select("id", "words").where(F.col("words") > TARGET_WORDS)


def _large_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ps.semantic_units(ps.sized(_chunks(spark, sf)).where(F.col("words") > TARGET_WORDS).drop("words"))


@query(SQL_UNITS + "select id, unit, kind, words, md5(text) text_md5 from units")
def semantic_units(spark: SparkSession, sf: str) -> DataFrame:
    return _large_chunks(spark, sf).select("id", F.posexplode_outer("units").alias("unit", "u")).where("u is not null").select("id", "unit", "u.kind", "u.words", F.md5("u.text").alias("text_md5"))


@query(SQL_UNITS + "select id, pack, p.kind kind, p.words as words from packs")
def packed_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = _large_chunks(spark, sf).withColumn("units", ps.merge_leading_heading(F.col("units")))
    return d.select("id", F.posexplode_outer(ps.packed(F.col("units"), "paragraph", "paragraph_group")).alias("pack", "u")).where("u is not null").select("id", "pack", "u.kind", "u.words")


@query(
    f"""with whole as (select doc_id, {_NORM.replace('X', "replace(text, chr(61599), '•')")} text from documents where text is not null), docs as (select doc_id, text, 'document' kind, {_WORDS.replace('X', 'text')}::bigint words from whole),
{_pieces_sql('docs', 'doc_id')} select doc_id, part, p.kind split_method, p.words as words, md5(p.text) text_md5 from (select doc_id, unnest(pieces) p, unnest(range(len(pieces))) part from piece_lists)"""
)
def sentence_pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").where("text is not null").select("doc_id", clean_text(F.col("text")).alias("text"), F.lit("document").alias("kind"))
    d = ps.split_to_target(docs.withColumn("words", word_count(F.col("text"))))
    return d.select("doc_id", F.posexplode_outer("pieces").alias("part", "p")).select("doc_id", "part", F.col("p.kind").alias("split_method"), F.col("p.words").alias("words"), F.md5("p.text").alias("text_md5"))


@query(SQL_RECORDS + "select * exclude (seg, whole, body) from records")
def corpus_records(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("id", "text", "metadata.*")


# ---- records made of whole documents: the checks' and tables' input, which SQL can say as well -------------------------

SQL_SIMPLE = f"""with simple as (select 'doc-' || (case when doc_id % 50 = 7 then doc_id - 1 else doc_id end)::varchar id, case when doc_id % 40 = 3 then ' ' else text end text, source document, '1.0' as version, lang "language",
  case when doc_id % 30 = 4 then '' else (doc_id % 9 + 1)::varchar end section, source parent_titles, 'documents' source_file, '' printed_page_start, (doc_id % 20)::bigint pdf_page_start, {_WORDS.replace('X', 'text')}::bigint word_count, doc_id from documents)
"""


def _simple(spark: SparkSession, sf: str, text: Column | None = None) -> DataFrame:
    d = read(spark, sf, "documents")
    n = F.col("doc_id")
    meta = F.struct(
        F.col("source").alias("document"), F.lit("1.0").alias("version"), F.col("lang").alias("language"), F.when(n % 30 == 4, "").otherwise((n % 9 + 1).cast("string")).alias("section"), F.col("source").alias("parent_titles"),
        F.lit("documents").alias("source_file"), F.lit("").alias("printed_page_start"), (n % 20).alias("pdf_page_start"), word_count(F.col("text")).cast("long").alias("word_count"),
    )
    return d.select(F.concat(F.lit("doc-"), F.when(n % 50 == 7, n - 1).otherwise(n).cast("string")).alias("id"), (F.when(n % 40 == 3, " ").otherwise(F.col("text")) if text is None else text).alias("text"), meta.alias("metadata"), n.alias("doc_id"))


@query(
    SQL_SIMPLE
    + """select id, doc_id, concat_ws(';', case when trim(text) = '' then 'blank text' end, case when section = '' then 'blank section' end, case when pdf_page_start < 1 then 'pdf_page_start below 1' end) violations
from simple where trim(text) = '' or section = '' or pdf_page_start < 1"""
)
def record_violations(spark: SparkSession, sf: str) -> DataFrame:
    return checks.record_violations(_simple(spark, sf), "quarantine").select("id", "doc_id", F.array_join("violations", ";").alias("violations"))


@query(SQL_SIMPLE + "select id, count(*) n from simple group by id having count(*) > 1")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_ids(_simple(spark, sf))


@query(SQL_SIMPLE + "select id, word_count from simple where word_count > 300")
def oversized_records(spark: SparkSession, sf: str) -> DataFrame:
    return checks.oversized_records(_simple(spark, sf))


@query(
    SQL_RECORDS
    + f"""select parent_chunk_id id, count(*) n_children, case when {_BARE.replace('X', "string_agg(body, '' order by part_number)")} <> {_BARE.replace('X', 'any_value(whole)')} then 'text differs' end problem
from records group by 1"""
)
def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_report(derived_pages(spark, sf))[1]


@query(
    SQL_RECORDS
    + """select source_kind, split_method, count(*) passages, count(distinct parent_chunk_id) parents, count(distinct case when part_count > 1 then parent_chunk_id end) split_parents, min(word_count) least_words, max(word_count) most_words,
case when grouping(source_kind) = 1 then (select count(*) from pages) end pages, case when grouping(source_kind) = 1 then (select count(*) from ids) end structural_chunks from records group by rollup (source_kind, split_method)"""
)
def chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_report(derived_pages(spark, sf))[0]


@query(
    SQL_RECORDS
    + """select document, row_number() over (partition by document order by seg, part_number) as position, id, parent_chunk_id, section, source_kind, split_method, part_number::varchar || ' / ' || part_count::varchar part,
case when parent_titles = '' then '—' else replace(parent_titles, ' > ', ' → ') end parent_titles, pdf_page_start, printed_page_start, word_count, text_sha256, text from records"""
)
def review_rows(spark: SparkSession, sf: str) -> DataFrame:
    return checks.review_rows(build_records(derived_pages(spark, sf), place=True))


@query(
    f"""with d as (select doc_id, text, source, {_WORDS.replace('X', 'text')}::bigint words, doc_id % 40 = 3 broken from documents)
select 'doc-' || doc_id::varchar id, case when not broken then length(text) end::bigint n_chars, case when not broken then source end document, case when not broken then words end word_count, broken, case when broken then true end has_file, case when broken then true end has_line from d"""
)
def load_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document written as a line of JSON, some of them cut off, and read back: records, and broken lines, whose file and
    line are known (the tests hold them against the files)."""
    d = _simple(spark, sf, text=F.col("text")).select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "text", "metadata")
    wire = F.to_json(F.struct("id", "text", "metadata"))
    path = tables.scratch(spark, "passages")
    d.select(F.when(F.col("doc_id") % 40 == 3, F.substring(wire, 1, 30)).otherwise(wire).alias("value")).write.text(path)
    good, broken = tables.read_passages(spark, path)
    told = broken.select(F.regexp_extract("value", "doc-[0-9]+", 0).alias("id"), F.lit(True).alias("broken"), F.col("file").contains("/passages-").alias("has_file"), (F.col("line") >= 1).alias("has_line"))
    good = good.select("id", F.length("text").alias("n_chars"), "metadata.document", "metadata.word_count", F.lit(False).alias("broken"))
    return good.unionByName(told, allowMissingColumns=True)


@query(
    SQL_RECORDS
    + """select id, to_json({'id': id, 'text': text, 'metadata': {'document': document, 'version': version, 'language': "language", 'section': section, 'parent_titles': parent_titles, 'parent_chunk_id': parent_chunk_id, 'source_kind': source_kind, 'split_method': split_method,
'part_number': part_number, 'part_count': part_count, 'pdf_page_start': pdf_page_start, 'printed_page_start': printed_page_start, 'word_count': word_count, 'text_sha256': text_sha256, 'source_file': source_file}})::varchar json from records"""
)
def passages_as_json(spark: SparkSession, sf: str) -> DataFrame:
    return tables.passages_as_json(_records(spark, sf))


@query(SQL_SIMPLE + "select id, doc_id, document, 0::bigint handler from simple where doc_id % 2 = 0 union all select id, doc_id, document, 1::bigint from simple where doc_id % 2 = 1")
def combined_records(spark: SparkSession, sf: str) -> DataFrame:
    half = lambda k: _simple(spark, sf).where(F.col("doc_id") % 2 == k).select("id", "doc_id", "metadata.document", F.lit(k).alias("handler"))
    return tables.combined_records([lambda: half(0), lambda: half(1)])


# ---- vectors -----------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("text-"), F.col("vec_id").cast("string")).alias("text"), "embedding", "label")


_CHANGED = "list_transform(range(len(embedding)), lambda i: embedding[len(embedding) - i])"


@query(f"select vec_id id, label::bigint as label, round((case when vec_id % 10 = 0 then embedding[len(embedding)] else embedding[1] end)::double, 5) first_value, vec_id % 10 = 0 changed from embeddings where vec_id % 3 = 0 or vec_id % 10 = 0")
def upsert_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    new = v.where("id % 10 = 0").withColumn("embedding", F.reverse("embedding")).withColumn("changed", F.lit(True))
    d = tables.upserted(v.where("id % 3 = 0").withColumn("changed", F.lit(False)), new)
    return d.select("id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value"), "changed")


@query(
    """select 'bucket' model, 'section,parent_titles,text' input_fields, count(*) chunk_count, count(distinct vec_id) ids, max(len(embedding))::bigint dimension, 8::bigint batch_size,
concat_ws('-', """
    + ", ".join(f"(sum(('0x' || sha256(vec_id::varchar || chr(31) || 'text-' || vec_id::varchar)[{1 + 16 * i}:{16 + 16 * i}])::hugeint) % 18446744073709551616::hugeint)::varchar" for i in range(4))
    + ") source_hash from embeddings"
)
def build_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return tables.build_manifest(_vectors(spark, sf), "bucket", timed=False)


@query("select vec_id id, label::bigint as label from embeddings where vec_id % 3 <> 0")
def remaining_passages(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return vec.remaining_passages(v, v.where("id % 3 = 0")).select("id", "label")


@query("select -vec_id id from embeddings where vec_id % 7 = 0 and vec_id > 0")
def unexpected_ids(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return vec.unexpected_ids(v, v.select("id").union(v.where("id % 7 = 0 and id > 0").select(-F.col("id"))))


@query("""select doc_id id, 'Section: ' || lang || chr(10) || 'Parent sections: ' || source || chr(10) || 'Text: ' || text input from documents""")
def embedding_inputs(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    r = d.select(F.col("doc_id").alias("id"), ps.record_text(F.col("lang"), F.array("source"), F.col("text")).alias("text"), F.struct(F.col("lang").alias("section"), F.col("source").alias("parent_titles")).alias("metadata"))
    return vec.embedding_inputs(r)


_EMBED = """with w as (select item_id id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*')) t from benchmark),
b as (select id, ('0x' || md5(t)[1:8])::bigint % 64 bucket, count(*) n from w group by 1, 2), s as (select id, sqrt(sum(n * n)) norm from b group by 1)
"""


@query(_EMBED + "select id, bucket::bigint bucket, round(n / norm, 6) as value from b join s using (id)")
def embed_passages(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("input"))
    made = vec.embed_passages(d, vec.bucket_embedder)
    return made.select("id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0").select("id", "bucket", F.round("value", 6).alias("value"))


@query("select count(*) n, min(len(embedding))::bigint least, max(len(embedding))::bigint most, count(case when len(embedding) = 0 then 1 end) as empty, min(len(embedding)) = max(len(embedding)) fits from embeddings")
def vector_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return vec.vector_dimensions(_vectors(spark, sf))


@query("select (select count(*) from embeddings) input_count, (select count(*) from embeddings where vec_id % 3 = 0) stored_count, false agrees")
def build_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return vec.build_counts(v, v.where("id % 3 = 0"))


def _cosine_sql(where: str, last: str, asked: str = "q.vec_id % 50 = 0") -> str:
    return f"""with pairs as (select q.vec_id query_id, v.vec_id id, round(list_dot_product(q.embedding::double[], v.embedding::double[]) / nullif(sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])), 0), 6) similarity
from embeddings q, embeddings v where {asked} {where}),
hits as (select *, row_number() over (partition by query_id order by similarity desc nulls last, id) as rank from pairs qualify row_number() over (partition by query_id order by similarity desc nulls last, id) <= 3) {last}"""


def _queries_of(v: DataFrame) -> DataFrame:
    return v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


@query(_cosine_sql("", "select query_id, rank, id, similarity, round(1 - similarity, 6) distance from hits"))
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return vec.cosine_topk(_queries_of(v), v)


@query(_cosine_sql("and v.label = 3", "select query_id, rank, id, similarity from hits"))
def filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return vec.cosine_topk(_queries_of(v), v.where("label = 3")).drop("distance")


@query(_cosine_sql("", "select query_id, rank, id, label::bigint as section, 'text-' || id::varchar as text, similarity from hits join embeddings on vec_id = id"))
def topk_with_provenance(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    names = ("document", "version", "section", "parent_titles", "pdf_page_start", "printed_page_start")
    records = v.select("id", "text", F.struct(*[(F.col("label") if n == "section" else F.lit("")).alias(n) for n in names]).alias("metadata"))
    return vec.topk_with_provenance(vec.cosine_topk(_queries_of(v), v), records).select("query_id", "rank", "id", "section", "text", "similarity")


@query(_cosine_sql("", "select query_id, string_agg('text-' || id::varchar, '|' order by rank) texts from hits group by 1"))
def retrieve_texts(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return conv.retrieve_texts(vec.cosine_topk(_queries_of(v), v), v).select("query_id", F.array_join("texts", "|").alias("texts"))


@query(
    _cosine_sql(
        "and q.vec_id % 100 = 0",
        """select vec_id query_id, 'Regulation search: text-' || vec_id::varchar || chr(10) || 'Search results:' || chr(10) || coalesce(string_agg('text-' || id::varchar, chr(10) || chr(10) order by rank), 'No matching regulations found.') evidence
from embeddings left join hits on query_id = vec_id where vec_id % 50 = 0 group by 1""",
    )
)
def evidence_messages(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    asked = _queries_of(v)
    texts = conv.retrieve_texts(vec.cosine_topk(asked.where("query_id % 100 = 0"), v), v)
    return conv.evidence_messages(asked.select("query_id", F.concat(F.lit("text-"), F.col("query_id").cast("string")).alias("query")), texts)


# ---- conversations -------------------------------------------------------------------------------------------------------


def _violation_sql(roles: str, last: str, why: str) -> str:
    return f"""select conv_id, count(*) turns, concat_ws('; ', case when max((role not in ({roles}))::int) = 1 then 'role not allowed' end, case when max((trim(coalesce(text, '')) = '')::int) = 1 then 'blank content' end,
case when arg_max(role, turn) <> '{last}' then '{why}' end) violations from conversations group by 1"""


@query(_violation_sql("'user', 'assistant', 'system'", "user", "last turn is not the user''s"))
def conversation_violations(spark: SparkSession, sf: str) -> DataFrame:
    return conv.conversation_violations(read(spark, sf, "conversations"))


@query(_violation_sql("'assistant', 'system'", "assistant", "last message is not the assistant''s"))
def response_violations(spark: SparkSession, sf: str) -> DataFrame:
    return conv.response_violations(read(spark, sf, "conversations"))


@query("select conv_id, turn, role, text from conversations where role in ('user', 'assistant')")
def agent_turns(spark: SparkSession, sf: str) -> DataFrame:
    return conv.agent_turns(read(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")


@query("select conv_id, (count(*) + 1)::bigint n_messages, 'system' first_role, string_agg(role, ',' order by turn) roles, md5(string_agg(text, chr(10) order by turn)) content_md5 from conversations where role in ('user', 'assistant') group by 1")
def prompt_messages(spark: SparkSession, sf: str) -> DataFrame:
    d = conv.prompt_messages(conv.agent_turns(read(spark, sf, "conversations")), "Answer from the regulations.")
    m = F.from_json("prompt", "array<struct<role:string,content:string>>")
    d = d.withColumn("m", m).withColumn("rest", F.slice("m", 2, F.size("m")))
    return d.select("conv_id", "n_messages", F.get("m", F.lit(0))["role"].alias("first_role"), F.array_join("rest.role", ",").alias("roles"), F.md5(F.array_join("rest.content", "\n")).alias("content_md5"))


#: Replies laid over conversations by turn and id: one of each kind.
_REPLY = """case (conv_id * 7 + turn) % 9 when 0 then '' when 1 then 'plain words' when 2 then '```json {{}} ```' when 3 then '{{"type": "other"}}' when 4 then '{{"type": "tool_call", "tool": "web", "arguments": {{"text": "q"}}}}'
when 5 then '{{"type": "tool_call", "tool": "retrieve_regulations", "arguments": {{"text": "question {0}"}}}}' when 6 then '{{"type": "answer", "content": " "}}' when 7 then '[1]' else '{{"type": "answer", "content": "answer {0}"}}' end"""
_SPARK_REPLY = _REPLY.format("' || cast(conv_id as string) || '")
_DUCK_REPLY = _REPLY.format("' || conv_id::varchar || '")
_CLASS_SQL = f"""with r as (select conv_id, turn, {_DUCK_REPLY} as output from conversations),
c as (select conv_id, turn, output, case when trim(output) = '' then 'empty' when starts_with(output, '```') then 'code_fence' when not json_valid(output) then 'invalid_json' when json_type(output) <> 'OBJECT' then 'non_object'
when output->>'type' = 'answer' then case when trim(coalesce(output->>'content', '')) = '' then 'empty_answer' else 'answer' end when output->>'type' <> 'tool_call' then 'unknown_type' when output->>'tool' <> 'retrieve_regulations' then 'unknown_tool'
when trim(coalesce(output->'arguments'->>'text', '')) = '' then 'bad_search_text' else 'tool_call' end kind from r)
"""


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", "turn", F.expr(_SPARK_REPLY).alias("output"))


@query(_CLASS_SQL + "select conv_id, turn, kind, case when kind = 'answer' then output->>'content' end as content, case when kind = 'tool_call' then output->'arguments'->>'text' end as query from c")
def reply_classes(spark: SparkSession, sf: str) -> DataFrame:
    return conv.reply_classes(_replies(spark, sf)).select("conv_id", "turn", "reply.kind", "reply.content", "reply.query")


_TURN_SQL = (
    _CLASS_SQL
    + ", "
    + _cosine_sql("", "", "q.vec_id in (select conv_id from c where kind = 'tool_call' and conv_id % 2 = 0)").removeprefix("with ")
    + """, found as (select query_id, string_agg('text-' || id::varchar, chr(10) || chr(10) order by rank) texts from hits group by 1), t as (
select conv_id, turn, 0 turn_order, 'assistant' as role, output->>'content' as text from c where kind = 'answer'
union all select conv_id, turn, 0, 'system', 'Regulation search: question ' || conv_id::varchar || chr(10) || 'Search results:' || chr(10) || coalesce(texts, 'No matching regulations found.') from c left join found on query_id = conv_id where kind = 'tool_call'
union all select conv_id, turn, 1, 'assistant', 'final ' || conv_id::varchar from c where kind = 'tool_call')
"""
)


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of every conversation: its reply is the first phase's. Searches of even conversations find the passages
    nearest to the vector with the conversation's number; the others find nothing."""
    first = conv.reply_classes(_replies(spark, sf))
    asked = first.where("reply.kind = 'tool_call'").select(F.struct("conv_id", "turn").alias("query_id"), F.col("reply.query").alias("query"))
    v = _vectors(spark, sf)
    searched = v.join(asked.where("query_id.conv_id % 2 = 0").select(F.col("query_id.conv_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")
    texts = conv.retrieve_texts(vec.cosine_topk(searched, v), v).withColumnRenamed("query_id", "conv_id")
    texts = asked.select("query_id", F.col("query_id.conv_id").alias("conv_id")).join(texts, "conv_id").select("query_id", "texts")
    evidence = conv.evidence_messages(asked, texts).select("query_id.conv_id", "query_id.turn", "evidence")
    final = first.select("conv_id", "turn", F.concat(F.lit('{"type": "answer", "content": "final '), F.col("conv_id").cast("string"), F.lit('"}')).alias("output"))
    return conv.turn_messages(first, evidence, conv.reply_classes(final, conv.PHASES[1]), ("conv_id", "turn"))


@query(_TURN_SQL + "select conv_id, turn, turn_order::bigint turn_order, role, text from t")
def turn_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf)


@query(
    _TURN_SQL
    + """, new as (select conv_id, turn, -1 turn_order, 'user' as role, text from conversations semi join t using (conv_id, turn) union all select conv_id, turn, turn_order, role, text from t),
placed as (select *, row_number() over w - 1 as position, count(*) filter (role in ('user', 'assistant')) over w shown from new window w as (partition by conv_id order by turn, turn_order))
select conv_id, position, turn asked_turn, role, text, max(case when turn_order = -1 then shown end) over (partition by conv_id, turn) n_shown from placed"""
)
def appended_history(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations run from their first turn to the last: what each turn's text asks, and its replies."""
    return conv.run_conversations(read(spark, sf, "conversations").select("conv_id", "turn", "text"), _turns(spark, sf))


@query(
    SQL_RECORDS
    + """, w as (select 'r' side, id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*')) t from records
  union all select 'q', item_id::varchar, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*')) from benchmark),
b as (select side, id, ('0x' || md5(t)[1:8])::bigint % 64 bucket, count(*) n from w group by all), norms as (select side, id, sqrt(sum(n * n)) norm from b group by all),
dots as (select q.id qid, r.id rid, sum(q.n * r.n) d from b q join b r on q.bucket = r.bucket and q.side = 'q' and r.side = 'r' group by 1, 2),
near as (select qid, rid, round(d / (x.norm * y.norm), 6) similarity from dots join norms x on x.side = 'q' and x.id = qid join norms y on y.side = 'r' and y.id = rid),
hits as (select *, row_number() over (partition by qid order by similarity desc, rid) as rank from near qualify row_number() over (partition by qid order by similarity desc, rid) <= 3)
select item_id query_id, 'Regulation search: ' || any_value(q.text) || chr(10) || 'Search results:' || chr(10) || string_agg(records.text, chr(10) || chr(10) order by rank) evidence
from benchmark q join hits on qid = item_id::varchar join records on id = rid group by 1"""
)
def answered_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way: pages to records to vectors, and the evidence for each benchmark question."""
    questions = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return answer_questions(_records(spark, sf), questions, vec.bucket_embedder)

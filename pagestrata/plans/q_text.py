"""Text rules over whole documents, their lines and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import text as t
from pagestrata.functions.repeats import is_degenerate, trim_repeated_suffix
from pagestrata.plans.registry import query

WS = r"[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sstrip(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sclean(x):
    return sstrip(f"replace(replace(coalesce({x},''), chr(13)||chr(10), chr(10)), chr(13), chr(10))")


def scompact(x):
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


KH = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
NW = r"[^\p{L}\p{N}]"
FOLD = "replace(lower({}), 'ß', 'ss')".format
MARKUP = " or ".join(f"contains(lower(t), '{m}')" for m in t.MARKUP_MARKERS)
N_COORD = r"len(regexp_extract_all(t, '\(?\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*\)?'))"
COORD = f"({N_COORD}>=6 or ({N_COORD}>=3 and contains(t,'--')))"
DENSE = scompact("t")
NOISE = (
    rf"(length(d)>120 and (length(d)-length(regexp_replace(d,'[{{}}\[\]()<>/:;|,=\-_]','','g')))*1.0/length(d)>0.45 and "
    rf"length(d)-length(regexp_replace(d,'[\p{{L}}{KH}]','','g')) < length(d)-length(regexp_replace(d,'[{{}}\[\]()<>/:;|,=\-_]','','g')))"
)
TABLE = (
    rf"(length(t)>20 and regexp_matches(t,'\p{{Nd}}') and len(regexp_extract_all(t,'{WS}+'))<=1 and "
    r"len(list_distinct(list_transform(regexp_extract_all(t,'(?i)(category|value|blue|red|total|name|score)'), lambda z: lower(z))))>=2)"
)


def top_share(v, least):
    return f"(len(list_distinct({v}))<=2 and greatest(len(list_filter({v}, lambda z: z={v}[1])), len({v})-len(list_filter({v}, lambda z: z={v}[1])))*1.0/len({v})>={least})"


LINES = f"list_filter(list_transform(string_split(t,chr(10)), lambda z: {sstrip('z')}), lambda z: z<>'')"
PLAIN = f"list_filter(list_transform(ln, lambda z: {sstrip(f'''regexp_replace({FOLD('z')},'^{NW}+|{NW}+$','','g')''')}), lambda z: z<>'')"
TOKENS = f"list_transform(regexp_extract_all(t,'[A-Za-z0-9]+|[{KH}]+'), lambda z: {FOLD('z')})"
CHARS = "string_split(d,'')"
PATTERN = (
    "(length(d)>=16 and list_bool_or(list_transform([2,3,4,5,6,7,8], lambda u: u*4<=length(d) and "
    "greatest(4,(length(d)*4+u*5-1)//(u*5))*u<=length(d) and "
    "substring(d,1,greatest(4,(length(d)*4+u*5-1)//(u*5))*u)=repeat(substring(d,1,u),greatest(4,(length(d)*4+u*5-1)//(u*5))))))"
)
FLAGS = f"""f0 as (select *, {sclean('raw')} t from src), f1 as (select *, {DENSE} d, {LINES} ln, {TOKENS} tk from f0), f2 as (select *, {PLAIN} pl, {CHARS} ch from f1),
  f3 as (select *, ({MARKUP}) markup, {COORD} coordinates, {NOISE} noise, {TABLE} table_like, coalesce(len(pl)>=5 and {top_share('pl','0.70')},false) repeated_line,
    coalesce(length(d)>=12 and {top_share('ch','0.85')},false) repeated_char, coalesce(len(tk)>=6 and {top_share('tk','0.70')},false) repeated_token, coalesce({PATTERN},false) repeated_pattern from f2)"""
FLAG_NAMES = "markup, coordinates, noise, table_like, repeated_line, repeated_char, repeated_token, repeated_pattern"


def _flags(df, raw):
    staged = df.withColumn("t", t.cleaned_ocr(F.col(raw))).withColumn("d", t.compact(F.col("t")))
    c, d = F.col("t"), F.col("d")
    return staged.withColumns({
        "markup": t.has_markup(c), "coordinates": t.is_coordinates(c), "noise": t.is_structured_noise(c),
        "table_like": t.is_table_like(c), "repeated_line": t.is_repeated_line(c), "repeated_char": t.is_repeated_char(d),
        "repeated_token": t.is_repeated_token(c), "repeated_pattern": t.is_repeated_pattern(d),
    })


@query("text_rules_by_document", f"with src as (select doc_id, text raw from documents), {FLAGS} select doc_id, {FLAG_NAMES} from f3")
def _(v):
    return _flags(v.table("documents"), "text").select("doc_id", *FLAG_NAMES.split(", "))


@query("text_rules_by_line", f"with src as (select doc_id, line_no, line raw from fx_line), {FLAGS} select doc_id, line_no, {FLAG_NAMES} from f3", "fx_line")
def _(v):
    return _flags(v.line, "line").select("doc_id", "line_no", *FLAG_NAMES.split(", "))


# lines are judged as rows of their own, then collected again per document
FILTER_CTES = f"""ex as (select doc_id, generate_subscripts(ln,1) i, unnest(ln) z from f3),
  jd as (select doc_id, i, z, length({scompact('z')}) n, {scompact('z')} d, list_transform(regexp_extract_all(z,'[A-Za-z0-9]+|[{KH}]+'), lambda q: {FOLD('q')}) tk, string_split({scompact('z')},'') ch from ex),
  rs as (select doc_id, i, z, case when coalesce(n>=12 and {top_share('ch','0.85')},false) then 'repeated_character_hallucination'
    when coalesce(len(tk)>=6 and {top_share('tk','0.70')},false) then 'repeated_token_hallucination' when coalesce({PATTERN},false) then 'repeated_pattern_hallucination' end why from jd),
  ag as (select doc_id, string_agg(z, chr(10) order by i) filter (where why is null) kept, count(why) bad, arg_min(why, i) filter (where why is not null) first_why from rs group by 1),
  vd as (select f3.doc_id, t, case when t='' then 'empty_ocr_output' when provider<>'deepseek_ocr_llama' then '' when markup then 'structured_markup_non_text'
    when coordinates then 'coordinate_geometry_non_text' when noise then 'structured_hallucination_non_text' when table_like then 'table_like_non_text'
    when repeated_line then 'repeated_line_hallucination' when bad>0 and kept is null then first_why else '' end reason,
    provider='deepseek_ocr_llama' and bad>0 some_bad, kept from f3 left join ag using (doc_id))"""
FILTER_TAIL = FILTER_CTES + """
  select doc_id, case when reason<>'' then '' when some_bad then kept else t end clean_text, reason<>'' rejected, reason from vd"""


@query("filter_ocr_text", f"with src as (select doc_id, text raw, provider from fx_doc), {FLAGS}, {FILTER_TAIL}", "fx_doc")
def _(v):
    return t.filter_ocr_text(v.doc, F.col("text"), F.col("provider")).select("doc_id", "clean_text", "rejected", "reason")


@query("unwrap_json_text", f"with src as (select doc_id, text raw, provider from fx_doc), {FLAGS}, {FILTER_TAIL}", "fx_doc")
def _(v):
    # the same answers, although two thirds of the checked texts arrive inside JSON
    wrapped = F.when(F.col("provider") != t.FILTERED_PROVIDER, F.col("text")).when(
        F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content"), F.lit(3).alias("n")))
    ).otherwise(F.to_json(F.struct(F.to_json(F.struct(F.col("text").alias("ocr"))).alias("text"))))
    return t.filter_ocr_text(v.doc, wrapped, F.col("provider")).select("doc_id", "clean_text", "rejected", "reason")


# one line is never a list, so only marks inside it go; RE2 has no look-around, so a mark at the very end is fenced off first
MARKS = rf"\(\d{{1,2}}\)|\d{{1,2}}[.):]|[{t.CIRCLED_NUMBERS}]", r"[-–—*•・]"


def unmarked(x, marks):
    fenced = rf"regexp_replace({x}, '(^|\s)({marks})$', '\1'||chr(1)||'\2')"
    return rf"replace(regexp_replace({fenced}, '(^|\s)(?:{marks})', '\1', 'g'), chr(1), '')"


def joined_lines(x):
    """Lines without white space around them, joined by one space, none before punctuation."""
    rows = f"list_filter(list_transform(string_split({x}, chr(10)), lambda z: {sstrip('z')}), lambda z: z<>'')"
    return sstrip(rf"regexp_replace(regexp_replace(array_to_string({rows}, ' '), '{WS}+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')")


LIST_MARK = t.LINE_MARKER
PREFIXED = " ".join(f"when starts_with(lower(x), '{p.lower()}') then {sstrip(f'substr(x, {len(p) + 1})')}" for p in t.OUTPUT_PREFIXES)
CLEANED = rf"""with a as (select doc_id, {sstrip("coalesce(text,'')")} x, doc_id%3 k from documents), p as (select doc_id, case when k=1 then x {PREFIXED} else x end x from a),
  l as (select *, list_filter(string_split(x, chr(10)), lambda z: {sstrip('z')}<>'') fl from p), m as (select *, len(fl)>=2 and len(list_filter(fl, lambda z: regexp_matches(z, '{LIST_MARK}')))>=greatest(2, len(fl)-1) is_list from l),
  n as (select *, {unmarked('x', MARKS[0])} y from m), b as (select *, {unmarked('y', MARKS[1])} z from n),
  c as (select doc_id, case when is_list then {joined_lines(f"array_to_string(list_transform(string_split(x, chr(10)), lambda z: regexp_replace(z, '{LIST_MARK}', '')), chr(10))")} when z<>x then {joined_lines('z')} else x end t from b)
  select doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda z: {sstrip('z')}), lambda z: z<>''), lambda z: regexp_replace(z, '{WS}+', ' ', 'g')), chr(10)) tidy_text from c"""


@query("clean_model_output", CLEANED)
def _(v):
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("OCR: "), "text")).otherwise(F.to_json(F.struct("text")))
    return t.clean_model_output(v.table("documents"), fenced, "tidy_text").select("doc_id", "tidy_text")


@query("strip_list_markers", rf"""with l as (select doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') x from fx_line), n as (select *, {unmarked('x', MARKS[0])} y from l), b as (select *, {unmarked('y', MARKS[1])} z from n)
  select doc_id, line_no, case when z=x then x else trim(regexp_replace(regexp_replace(trim(z), '\s+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')) end bare from b""", "fx_line")
def _(v):
    return v.line.select("doc_id", "line_no", t.strip_list_markers(F.col("line")).alias("bare"))


TAILS = f"""tl as (select doc_id, line_no, line, {sstrip("coalesce(line,'')")} c, list_reverse(string_split({scompact("coalesce(line,'')")},'')) ch0 from fx_line), t0 as (select *, case when c='' then cast([] as varchar[]) else ch0 end ch from tl),
  t1 as (select *, list_max(list_transform(range(1,13), lambda u: case when u*4<=len(ch) and ((coalesce(list_position(list_transform(range(1,len(ch)-u+1), lambda i: ch[i]=ch[i+u]), false)-1, len(ch)-u)//u)+1)*u>=greatest(4*u,12)
    then ((coalesce(list_position(list_transform(range(1,len(ch)-u+1), lambda i: ch[i]=ch[i+u]), false)-1, len(ch)-u)//u)+1)*u else 0 end)) tail from t0),
  t2 as (select *, case when tail=0 then c when tail=len(ch) then '' else {sstrip("substr(c, 1, list_filter(range(1,length(c)+1), lambda i: not regexp_matches(substr(c,i,1), '" + WS + "'))[len(ch)-tail])")} end kept, tail>0 trimmed, len(ch) size, len(list_distinct(ch)) uniq from t1),
  t3 as (select *, c<>'' and size>=12 and (uniq<=2 or (trimmed and (kept='' or size>=18)) or (size>=24 and uniq*1.0e0/size<0.18)) degenerate from t2)"""


@query("trim_repeated_suffix", f"with {TAILS} select doc_id, line_no, kept, trimmed, degenerate from t3", "fx_line")
def _(v):
    tail = trim_repeated_suffix(F.col("line"))
    df = v.line.withColumn("tail", tail)
    return df.select(
        "doc_id", "line_no", F.col("tail.text").alias("kept"), F.col("tail.trimmed").alias("trimmed"),
        is_degenerate(F.col("line"), F.col("tail")).alias("degenerate"),
    )


def sub(x, pattern, to, flags="g"):
    return f"regexp_replace({x}, '{pattern}', '{to}', '{flags}')"


_unescaped = "html"
# the references that occur in the table; SQL has no function for all of them
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", chr(160)), ("&copy;", "©"), ("&middot;", "·")):
    _unescaped = f"replace({_unescaped}, '{_e}', {'chr(39)' if _c == chr(39) else 'chr(160)' if _c == chr(160) else chr(39) + _c + chr(39)})"
_unescaped = f"regexp_replace({_unescaped}, '&amp;?', '&', 'g')"


@query("strip_markup", f"""with a as (select page_id, {sub(_unescaped, '<!--.*?-->', '', 'gs')} h from pages),
  b as (select page_id, {sub(sub(sub('h', '<br\\s*/?>', ' ', 'gi'), f'</?(?:{t.FORMAT_TAGS})' + chr(92) + 'b[^>]*>', '', 'gi'), '</?[A-Za-z][A-Za-z0-9:_-]*(?:' + chr(92) + 's+[^<>]*)?>', '')} h from a),
  c as (select page_id, {sub(sub("replace(h, chr(160), ' ')", '[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'f' + chr(92) + 'x0b]+', ' '), chr(92) + 's*' + chr(92) + 'n' + chr(92) + 's*', ' ')} h from b)
  select page_id, {sstrip(sub('h', chr(92) + 's+([,.!?;:…。、！？])', chr(92) + '1'))} plain from c""")
def _(v):
    return v.table("pages").select("page_id", t.strip_markup(F.col("html")).alias("plain"))


@query("clean_english", f"""with p as (select doc_id, line_no, {sstrip("translate(" + sstrip('line') + ", '’‘“”', chr(39)||chr(39)||'""')")} s from fx_line),
  q as (select doc_id, line_no, {sstrip(sub('s', WS + '+', ' '))} s from p),
  j as (select doc_id, line_no, s, {sub('s', chr(92) + 's+([,.!?;:])', chr(92) + '1')} u from q)
  select doc_id, line_no, s piece, {sstrip(sub(sub('u', chr(92) + 'b([A-Za-z])' + chr(92) + 's+' + chr(39) * 2 + chr(92) + 's*([A-Za-z])', chr(92) + '1' + chr(39) * 2 + chr(92) + '2'), WS + '+', ' '))} joined,
    replace(replace(s,'|','I'),'．','.') bubble from j""", "fx_line")
def _(v):
    line = F.col("line")
    return v.line.select(
        "doc_id", "line_no", t.clean_piece(line).alias("piece"), t.clean_joined(line).alias("joined"),
        t.ascii_dot(t.clean_bubble_text(t.clean_piece(line))).alias("bubble"),
    )


@query("ocr_keys", f"""with k as (select project_id, page_no, regexp_replace(upper(replace(source_text,'ß','ss')),'{NW}+','','g') a, regexp_replace(upper(replace(translated_text,'ß','ss')),'{NW}+','','g') b,
    regexp_replace(upper(replace(concat(source_text,'!?'),'ß','ss')),'{NW}+','','g') c from fx_pair)
  select project_id, page_no, a as source_key, a<>'' and b<>'' and (a=b or (least(length(a),length(b))>=6 and (contains(a,b) or contains(b,a)) and least(length(a),length(b))*1.0/greatest(length(a),length(b))>=0.75)) alike,
    a<>'' and a=c like_self from k""", "fx_pair")
def _(v):
    keys = v.pair.select(
        "project_id", "page_no", t.ocr_key(F.col("source_text")).alias("source_key"), t.ocr_key(F.col("translated_text")).alias("b"),
        t.ocr_key(F.concat("source_text", F.lit("!?"))).alias("c"),
    )
    return keys.select(
        "project_id", "page_no", "source_key", t.ocr_similar(F.col("source_key"), F.col("b")).alias("alike"),
        t.ocr_similar(F.col("source_key"), F.col("c")).alias("like_self"),
    )


@query("contains_cjk", f"""select doc_id, line_no, regexp_matches(line, '{t.cjk_class()}') cjk from fx_line""", "fx_line")
def _(v):
    return v.line.select("doc_id", "line_no", t.contains_cjk(F.col("line")).alias("cjk"))


@query("vertical_tokens", r"""select doc_id, line_no, cast(len(g) as bigint) n, array_to_string(g,'|') tokens from (select doc_id, line_no,
    regexp_extract_all(replace(concat(line,'!?!',line,'??'),chr(10),''), '[!?！？‼⁉]{{2}}|[^\n]') g from fx_line) q""".replace("{{", "{").replace("}}", "}"), "fx_line")
def _(v):
    tokens = t.vertical_tokens(F.concat("line", F.lit("!?!"), "line", F.lit("??")))
    return v.line.select("doc_id", "line_no", F.size(tokens).cast("long").alias("n"), F.array_join(tokens, "|").alias("tokens"))


@query("writing_mode", f"""with s as (select doc_id, line_no, doc_id+line_no part_key, length(line)%97 bw, (doc_id+3*line_no)%90 bh, case when (doc_id+line_no)%3=0 then concat(line,'文') else line end tx from fx_line),
  k as (select *, regexp_matches(tx,'{t.cjk_class()}') cjk, part_key%4=0 up, part_key%5<>0 au, part_key%7<>0 vc, greatest(1,bh)>=cast(floor(greatest(1,bw)*1.1e0) as bigint) tall,
    case part_key%6 when 0 then 'horizontal' when 1 then 'vertical_rl' when 2 then 'auto' else 'inherit' end ov from s)
  select doc_id, line_no, case when ov in ('horizontal','vertical_rl') then ov when ov='auto' then case when cjk and (up or tall) then 'vertical_rl' else 'horizontal' end
    when vc and cjk and (up or (au and tall)) then 'vertical_rl' else 'horizontal' end as mode from k""", "fx_line")
def _(v):
    p = F.col("doc_id") + F.col("line_no")
    override = F.when(p % 6 == 0, "horizontal").when(p % 6 == 1, "vertical_rl").when(p % 6 == 2, "auto").otherwise("inherit")
    return v.line.select("doc_id", "line_no", t.writing_mode(
        F.when(p % 3 == 0, F.concat("line", F.lit("文"))).otherwise(F.col("line")), F.length("line").cast("long") % 97, (F.col("doc_id") + 3 * F.col("line_no")) % 90,
        F.when(p % 4 == 0, "Vertical").otherwise("horizontal"), p % 5 != 0, p % 7 != 0, override,
    ).alias("mode"))


@query("quota_errors", "select doc_id, line_no, regexp_matches(lower(line), '429|quota|rate limit|resource_exhausted|too many requests') quota from fx_line", "fx_line")
def _(v):
    return v.line.select("doc_id", "line_no", t.is_quota_error(F.col("line")).alias("quota"))

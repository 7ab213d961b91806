"""SQL for DuckDB that gives the rows of a query by a plainer way."""

# Fixed values, stated here anew so that a slip in the operator's tables shows: letters and
# the Latin letters they look like, in the same order; invisible characters; spaces.
_LETTERS = "АВЕЅІЈКМНОРСТХҮԌԚԜ" "аеѕіјорсухһԁԛԝӏӀ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "νορϲϹϳͿ" "ՏՕօհոսց" "ɑɡ"
_LATIN = "ABESIJKMHOPCTXYGQW" "aesijopcyxhdqwlI" "ABEZHIKMNOPTYX" "vopcCjJ" "SOohnug" "ag"
_UNSEEN = (
    r"\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}"
    r"\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0000}-\x{e0fff}"
)
_BLANKS = r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"


def _consistent(column: str) -> str:
    """The consistent form by plain SQL: spaces, invisible characters, full-width forms and
    look-alike letters by translation, then composition of the whole text."""
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    spaced = f"regexp_replace({column}, '[{_BLANKS}]', ' ', 'g')"
    seen = f"regexp_replace({spaced}, '[{_UNSEEN}]', '', 'g')"
    return f"nfc_normalize(translate({seen}, '{full}{_LETTERS}', '{plain}{_LATIN}'))"


_WINDOWS = """w as (select doc_id, k, md5(substring(text, k + 1, 200)) as h from (select doc_id, text, unnest(range(length(text) - 199)) as k from documents where length(text) >= 200)),
common as (select h from w group by 1 having count(distinct doc_id) > 1),
m as (select doc_id, k, lag(k) over (partition by doc_id order by k) as before from w join common using (h)),
i as (select doc_id, k, sum((before is null or k > before + 200)::int) over (partition by doc_id order by k) as span from m),
spans as (select doc_id, min(k)::int as span_start, (max(k) + 200)::int as span_end from i group by doc_id, span)"""

SQL = {
    "p3_found": f"""
with p as materialized (select response_id, regexp_extract_all(lower({_consistent("any_value(markdown)")}), '[\\p{{L}}\\p{{N}}]+') as words
  from preview_responses where markdown is not null group by 1),
s as materialized (select distinct response_id as id, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] as sh from (select response_id, words, unnest(range(1, len(words) - 1)) as k from p where len(words) >= 100)),
n as (select id, count(*) as n from s group by 1),
c as (select a.id as id_a, b.id as id_b, count(*) as common from s a join s b on a.sh = b.sh and a.id < b.id group by 1, 2)
select id_a, id_b from c join n x on x.id = id_a join n y on y.id = id_b where common / (x.n + y.n - common)::double >= 0.7
""",
    "p3_classes": f"""
with p as materialized (select response_id, regexp_extract_all(lower({_consistent("any_value(markdown)")}), '[\\p{{L}}\\p{{N}}]+') as words
  from preview_responses where markdown is not null group by 1),
r as materialized (select response_id, words, min(response_id) over (partition by words) as rep from p where len(words) >= 100),
s as materialized (select distinct rep as id, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] as sh from (select rep, words, unnest(range(1, len(words) - 1)) as k from r where rep = response_id)),
n as (select id, count(*) as n from s group by 1),
c as (select a.id as a, b.id as b, count(*) as common from s a join s b on a.sh = b.sh and a.id < b.id group by 1, 2),
l as (select unnest([a, b]) as rep from c join n x on x.id = a join n y on y.id = b where common / (x.n + y.n - common)::double >= 0.7),
k as (select rep, count(*) as n from l group by 1)
select response_id, rep as class_id, coalesce(k.n, 0) as n_links from r left join k using (rep)
""",
    "p3_links": f"""
with p as materialized (select response_id, regexp_extract_all(lower({_consistent("any_value(markdown)")}), '[\\p{{L}}\\p{{N}}]+') as words
  from preview_responses where markdown is not null group by 1),
r as materialized (select response_id, words, min(response_id) over (partition by words) as rep from p where len(words) >= 100),
s as materialized (select distinct rep as id, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] as sh from (select rep, words, unnest(range(1, len(words) - 1)) as k from r where rep = response_id)),
n as (select id, count(*) as n from s group by 1),
c as (select a.id as a, b.id as b, count(*) as common from s a join s b on a.sh = b.sh and a.id < b.id group by 1, 2)
select a as class_a, b as class_b, round(common / (x.n + y.n - common)::double, 9) as similarity from c join n x on x.id = a join n y on y.id = b where common / (x.n + y.n - common)::double >= 0.7
""",
    "p4_found": f"""
with p as (select response_id, any_value(title) as title, any_value(markdown) as markdown from preview_responses group by 1),
f as (select response_id as id, 'title' as field_name, title as raw from p where title <> '' union all select response_id, 'markdown', markdown from p where markdown <> ''),
c as materialized (select *, {_consistent("raw")} as form from f)
select a.field_name, a.id as id_a, b.id as id_b from c a join c b on a.field_name = b.field_name and a.form = b.form and a.raw <> b.raw and a.id < b.id
""",
    "p4_classes": f"""
with p as (select response_id, any_value(title) as title, any_value(markdown) as markdown from preview_responses group by 1),
f as (select response_id as id, 'title' as field_name, title as raw from p where title <> '' union all select response_id, 'markdown', markdown from p where markdown <> ''),
c as materialized (select *, {_consistent("raw")} as form from f),
k as (select field_name, form, count(*) as n, min(id) as class_id, count(distinct raw) as spellings from c group by 1, 2),
o as (select field_name, raw, count(*) as n from c group by 1, 2)
select c.field_name, c.id as response_id, k.class_id, k.n - o.n as n_links from c join k using (field_name, form) join o on o.field_name = c.field_name and o.raw = c.raw where k.spellings > 1
""",
    "p7_checks": "select pack_id, (select count(*) from documents) as documents, 0::bigint as split_small, 0::bigint as overfull from pack_sizes",
    "p8_found": f"with {_WINDOWS} select * from spans",
    "p8_shares": f"""with {_WINDOWS}, t as (select doc_id, sum(span_end - span_start)::bigint as n from spans group by 1)
select doc_id, length(text)::int as n_text, case when text is not null then coalesce(n, 0) end as n_shared, case when length(text) > 0 then coalesce(n, 0) / length(text)::double end as shared_part
from documents left join t using (doc_id)""",
    "p5_found": """
with pages as (select response_id, any_value(markdown) as markdown from preview_responses group by 1),
sites as (
  select response_id, min(regexp_replace(regexp_extract(lower(final_url),
    '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '')) as site
  from results where final_url is not null group by 1),
pieces as (
  select response_id, unnest(string_split(markdown, chr(10))) as line,
         generate_subscripts(string_split(markdown, chr(10)), 1) as line_no
  from pages where markdown is not null),
lines as (
  select p.response_id, p.line_no, s.site,
         lower(trim(regexp_replace(p.line, '[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))) as line
  from pieces p join sites s using (response_id)
  where length(regexp_replace(p.line, '[^\\p{L}\\p{N}]', '', 'g')) >= 3),
heavy as (select site, line from lines group by 1, 2 having count(distinct response_id) >= 5)
select response_id, line_no::int as line_no from lines join heavy using (site, line)
""",
}

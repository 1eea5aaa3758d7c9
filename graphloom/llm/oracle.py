"""The training-data queries that plain SQL can express, over the driver's tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE_WORDS = r"regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text,''),'{_UPPER}','{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LETTERS = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x'||substr(h,{5 * i + 1},5) as bigint) >> {15 - 5 * j}) & 31 as int)+1, 1)" for i in range(8) for j in range(4)
)

OP5 = f"""with p as (select page_id, coalesce(html,'') as body, sha1(coalesce(html,'')) as h from pages),
m as (select body, max(page_id) as head from p group by body)
select page_id, cast(strlen(p.body) as bigint) as payload_bytes, {_LETTERS} as payload_digest,
 case when page_id=head then 'response' else 'revisit' end as record_type, case when page_id<>head then head end as refers_to
from p join m on m.body=p.body"""

OP7 = f"""with d as (select doc_id, {_ITEM_WORDS} as w from documents),
i as (select item_id, {_ITEM_WORDS} as w from benchmark),
iw as (select item_id, least(10,len(w)) as n, array_to_string(w[k:k+least(10,len(w))-1],' ') as win from (select item_id, w, unnest(range(1, len(w)-least(10,len(w))+2)) as k from i where len(w)>0)),
dw as (select doc_id, k, n, array_to_string(w[k:k+n-1],' ') as win from (select doc_id, w, n, unnest(range(1, len(w)-n+2)) as k from d cross join (select distinct n from iw))),
m as (select distinct doc_id, k, dw.n, item_id from dw join iw on iw.win=dw.win and iw.n=dw.n),
hit as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(k, k+n)) as p from m) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit,0) as n_hit, coalesce(n_items,0) as n_items, sha256(coalesce(items,'')) as items_sha256, coalesce(n_hit,0)>0 as contaminated
from d left join hit on hit.doc_id=d.doc_id left join named on named.doc_id=d.doc_id"""

OP8 = f"""with d as (select doc_id, {_SPACE_WORDS} as w from documents),
x as (select doc_id, k, array_to_string(w[k:k+34],' ') as win from (select doc_id, w, unnest(range(1, len(w)-33)) as k from d)),
hit as (select distinct doc_id, unnest(range(k, k+35)) as p from (select doc_id, k, count(*) over (partition by win) as n from x) where n>1),
kept as (select y.doc_id, string_agg(y.v, ' ' order by y.p) as rest from (select doc_id, unnest(w) as v, unnest(range(1, len(w)+1)) as p from d) y anti join hit on hit.doc_id=y.doc_id and hit.p=y.p group by y.doc_id),
gone as (select doc_id, count(*) as n from hit group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n,0) as n_removed, sha256(coalesce(rest,'')) as kept_sha256
from d left join gone on gone.doc_id=d.doc_id left join kept on kept.doc_id=d.doc_id"""

OP6 = """with d as (select doc_id, hex(encode(coalesce(text,''))) as h, octet_length(encode(coalesce(text,''))) as n from documents),
part as (select doc_id, base, n, substr(h, 2*base+1, 2198) as h from (select doc_id, h, n, unnest(range(0, n-99, 1000)) as base from d)),
w as (select doc_id, base+j as k, substr(h, 2*j+1, 200) as win from (select doc_id, base, h, unnest(range(0, least(1000, n-99-base))) as j from part)),
hit as (select doc_id, k from (select doc_id, k, row_number() over (partition by win order by doc_id, k) as r from w) where r>1),
run as (select doc_id, k, sum(case when k<=p+100 then 0 else 1 end) over (partition by doc_id order by k) as g from (select doc_id, k, lag(k) over (partition by doc_id order by k) as p from hit)),
span as (select doc_id, min(k) as s, max(k)+100 as e from run group by doc_id, g),
piece as (select x.doc_id, string_agg(substr(h, 2*b+1, 2*(s-b)), '' order by s) as kept, max(e) as e, count(*) as c, sum(e-s) as r
 from (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as b from span) x join d on d.doc_id=x.doc_id group by x.doc_id)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(r,0) as bigint) as n_removed, coalesce(c,0) as n_spans, sha256(unhex(coalesce(kept,'')||substr(h, 2*coalesce(e,0)+1))) as kept_sha256
from d left join piece p on p.doc_id=d.doc_id"""

ORACLES = {"op5_warc": OP5, "op6_suffix_array_dedup": OP6, "op7_benchmark_decontamination": OP7, "op8_substring_dedup": OP8}

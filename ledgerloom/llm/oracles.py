"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

from .licenses import _TERM, BLANK, COMMENT, MARKERS, PATH_SQL, SPDX, TEMPLATES, THRESHOLD


def _license_scan() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    return f"""
with base as (select coalesce(text, '') as text, doc_id, {PATH_SQL} as path, doc_id % 10 = 0 as is_file from documents),
templates(t, license, text) as (values {values}),
statement as (select t, license, unnest(regexp_extract_all(lower(text), '{_TERM}')) as term from templates),
marked as (select distinct text, is_file from base where regexp_matches(text, '(?i){MARKERS}')),
line as (select text, line, lag(line) over w as previous, lead(line) over w as following from (select text, unnest(lines) as line, unnest(range(len(lines))) as n from (select distinct text, string_split(text, chr(10)) as lines from marked)) window w as (partition by text order by n)),
named as (select * from line where regexp_matches(line, '(?i){MARKERS}')),
unit as (select distinct text, unit from (
  select text, line as unit from named union all select text, concat_ws(' ', line, following) from named union all select text, concat_ws(' ', previous, line) from named
  union all select text, unnest(string_split_regex(text, '{BLANK}')) from marked union all select text, unnest(regexp_extract_all(text, '(?m){COMMENT}')) from marked
  union all select text, text from marked where is_file) where regexp_matches(unit, '(?i){MARKERS}')),
word as (select unit, unnest(regexp_extract_all(lower(unit), '{_TERM}')) as term from (select distinct unit from unit)),
held as (select unnest(list_distinct(regexp_extract_all(lower(text), '{_TERM}'))) as term from base),
counted as (select term, count(*) as df from held where term in (select term from statement union select term from word) group by term),
n as (select count(*) as docs from base),
idf as (select s.term, ln((1 + n.docs) / (1 + coalesce(c.df, 0))) + 1 as idf from (select term from statement union select term from word) s left join counted c on s.term = c.term cross join n),
tw as (select t, license, term, count(*) * any_value(idf) as w from statement join idf using (term) group by t, license, term),
tn as (select t, sqrt(sum(w * w)) as norm from tw group by t),
uw as (select unit, term, count(*) * any_value(idf) as w from word join idf using (term) group by unit, term),
un as (select unit, sqrt(sum(w * w)) as norm from uw group by unit),
scored as (select unit, license, round(sum(uw.w * tw.w) / any_value(tn.norm) / any_value(un.norm), 4) as cosine from uw join tw using (term) join tn using (t) join un using (unit) group by unit, t, license),
best as (select text, license, cosine, row_number() over (partition by text order by cosine desc, license) as place from unit join scored using (unit) where cosine >= {THRESHOLD}),
said as (select *, nullif(regexp_extract(text, '{SPDX}', 1), '') as spdx from base),
files as (select doc_id, path, is_file, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, coalesce(spdx, license) as own_license, case when spdx is not null then 1.0::double else cosine end as cosine from said left join best on said.text = best.text and best.place = 1),
holders as (select dir as up, own_license, row_number() over (partition by dir order by cosine desc, own_license) as place from files where is_file and own_license is not null),
ancestors as (select dir, array_to_string(parts[1:n], '/') as up from (select dir, string_split(dir, '/') as parts, unnest(range(len(string_split(dir, '/')) + 1)) as n from (select distinct dir from files))),
nearest as (select dir, arg_max(up, length(up)) as from_dir, arg_max(own_license, length(up)) as up_license from ancestors join holders using (up) where place = 1 group by dir)
select doc_id, path, own_license, cosine, coalesce(own_license, up_license) as license, case when own_license is null then from_dir end as inherited_from
from files left join nearest using (dir)"""


ORACLES: dict[str, str] = {"op2_license_scan": _license_scan()}

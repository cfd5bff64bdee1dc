"""The same results in SQL, for an independent engine."""

CAT = """with e0 as (select *, sha256(props) as sha from events),
cat as (select concat('site', (user_id % 10)::varchar) as manifest, event_id as pos,
  concat('dev', user_id::varchar, '/', event_type, '.json') as name,
  case when event_id % 11 = 0 then '' else concat((cast(concat('0x', substr(sha, 1, 4)) as bigint) % 1000)::varchar, '-00000-', sha) end as target,
  length(props)::bigint as size, ts from e0),
"""
MID = "timestamp '2024-01-15 23:59:59'"
LATEST = "last as (select * exclude rn from (select *, row_number() over (partition by manifest, name order by ts desc, pos) rn from cat {w}) where rn = 1)"
SNAP = LATEST.format(w=f"where ts <= {MID}")
NOW = LATEST.format(w="")
FILES = "f as (select distinct concat(manifest, '/', name) as path from cat)"
MEMBERS = """members as (
  select distinct manifest as archive, target as member from cat where target <> '' and try_cast(split_part(target, '-', 1) as bigint) % 7 <> 0
  union all select manifest, concat('junk-', pos::varchar) from cat where pos % 97 = 0
  union all select distinct manifest, 'manifest.json' from cat where manifest <> 'site3'
  union all select distinct manifest, 'metadata.json' from cat where manifest <> 'site4')"""
COUNTS = """counts as (select manifest as archive, count(distinct name) as total_file_count, count(distinct target) as target_file_count from cat group by 1),
stored as (select archive, total_file_count + (case when archive = 'site5' then 1 else 0 end) as total_file_count, target_file_count from counts)"""
MISSING = "missing as (select manifest as archive, pos, name, target from cat c where target <> '' and not exists (select 1 from members m where m.archive = c.manifest and m.member = c.target))"
ORPHANS = "orphan as (select distinct archive, member from members m where member not in ('manifest.json', 'metadata.json') and not exists (select 1 from cat c where c.manifest = m.archive and c.target = m.member and c.target <> ''))"
MISMATCH = """mismatch as (
  select s.archive, 'total_file_count' as field, s.total_file_count as stored, c.total_file_count as actual from stored s join counts c using (archive) where s.total_file_count <> c.total_file_count
  union all select s.archive, 'target_file_count', s.target_file_count, c.target_file_count from stored s join counts c using (archive) where s.target_file_count <> c.target_file_count)"""
FOUND = f"""{MEMBERS}, {COUNTS}, {MISSING}, {ORPHANS}, {MISMATCH},
archives as (select distinct manifest as archive from cat),
found as (
  select archive, 'corrupted' as kind, '' as context from archives where archive = 'site9'
  union all select archive, 'missing manifest', '' from archives where archive <> 'site9' and archive not in (select archive from members where member = 'manifest.json')
  union all select archive, 'missing metadata', '' from archives where archive <> 'site9' and archive not in (select archive from members where member = 'metadata.json')
  union all select archive, 'missing target', concat(name, ': ', target) from missing where archive <> 'site9'
  union all select archive, 'orphan', member from orphan where archive <> 'site9'
  union all select archive, 'metadata mismatch', concat(field, ' ', stored::varchar, ' ', actual::varchar) from mismatch where archive <> 'site9')"""
TREE = f"""{FILES}, p as (select path, string_split(path, '/') as a from f),
x as (select path, i, array_to_string(list_slice(a, 1, i), '/') as dir, case when i = 0 then null else array_to_string(list_slice(a, 1, i - 1), '/') end as parent,
  i = len(a) - 1 as direct from (select path, a, unnest(range(0, len(a))) as i from p)),
t as (select dir, parent, count(*) as total, sum(case when direct then 1 else 0 end)::bigint as own from x group by 1, 2)"""
DOCS = "d as (select doc_id, sha256(text) as sha, concat((cast(concat('0x', substr(sha256(text), 1, 4)) as bigint) % 1000)::varchar, '-00000-', sha256(text)) as target from documents)"
AGGREGATES = "count(distinct name) as total_file_count, count(distinct target) as target_file_count, sum(size)::bigint as uncompressed_size, min(ts) as oldest_file_ts, max(ts) as newest_file_ts"

#: The generator's rules: a second of the year, a depth, a content and an
#: extension, from digests of row and key.
ROLL = "cast(concat('0x', substr(sha256(concat(i::varchar, '-', '{k}')), 1, 12)) as bigint)"
SEED = f"""with n as (select range as i from range(10000)),
r as (select i, timestamp '2024-01-01' + to_seconds({ROLL.format(k=42)} % 31536000) as ts, {ROLL.format(k=43)} % 100 as d, {ROLL.format(k=44)} % 50 as c, {ROLL.format(k=45)} % 2 as e from n),
q as (select *, string_split(strftime(ts, '%Y/%m/%d/%H/%M/%S'), '/') as parts, case when d < 5 then 1 when d < 10 then 2 when d < 15 then 3 when d < 25 then 4 when d < 40 then 5 else 6 end as levels from r),
files as (select array_to_string(list_slice(parts, 1, levels), '/') as folder, concat(sha256(c::varchar), chr(10)) as content, ts,
  concat(array_to_string(list_slice(parts, 1, levels), '/'), '/part', lpad((i // 1000)::varchar, 6, '0'), '/', lpad(lower(to_hex(i)), 8, '0'), case when e = 0 then '.json' else '.txt' end) as name from q)"""


def _boundaries(n: int) -> str:
    return CAT + TREE + f""" select t.dir as path, t.total <= {n} as include_subdirs, case when t.total <= {n} then t.total else t.own end as files
from t left join t q on t.parent = q.dir
where (t.total <= {n} and (t.parent is null or q.total > {n})) or (t.total > {n} and t.own > 0)"""


def _children(rows: str, prefix: str) -> str:
    n = len(prefix) + 1
    return f""" , r as (select substr(name, {n}) as rest from {rows} where target <> '' and starts_with(name, '{prefix}'))
select rest as entry, 'file' as kind from r where instr(rest, '/') = 0
union all select distinct split_part(rest, '/', 1), 'dir' from r where instr(rest, '/') > 0"""


SQL = {
    "asof_snapshot": CAT + SNAP + " select * from last where target <> ''",
    "asof_point": CAT + SNAP + " select * from last where target <> '' and manifest = 'site3' and name = 'dev3/click.json'",
    "asof_prefix": CAT + SNAP + " select * from last where target <> '' and starts_with(name, 'dev1')",
    "prefix_exists_asof": CAT + SNAP + " select count(*) > 0 as found from last where target <> '' and starts_with(name, 'dev10/')",
    "prefix_exists": CAT + NOW + " select count(*) > 0 as found from cat where target <> '' and starts_with(name, 'dev99999/')",
    "live_latest": CAT + NOW + " select * from last where target <> ''",
    "live_first": CAT + "r as (select *, row_number() over (partition by manifest, name order by pos) rn from cat where target <> '') select * exclude rn from r where rn = 1",
    "live_prefix_versions": CAT + NOW + " select * from cat where target <> '' and starts_with(name, 'dev10/')",
    "collapse": CAT + "r as (select *, row_number() over (partition by manifest, name order by ts desc, pos desc) rn from cat) select * exclude rn from r where rn = 1",
    "last_state": CAT + "r as (select *, row_number() over (partition by manifest, name order by pos desc) rn from cat) select * exclude rn from r where rn = 1",
    "active_count": CAT + "r as (select *, row_number() over (partition by manifest, name order by pos desc) rn from cat) select manifest, count(*) filter (target <> '') as active_files from r where rn = 1 group by 1",
    "version_history": CAT + NOW + " select *, row_number() over w as version, lead(ts) over w as until_ts from cat window w as (partition by manifest, name order by ts, pos)",
    "table_remove_position": CAT + NOW + " select * from cat where pos <> 42",
    "table_get_position": CAT + NOW + " select * from cat where pos = 42",
    "tombstone_append": CAT + NOW + " select * from last where target <> '' and not (manifest = 'site3' and name = 'dev3/click.json')",
    "file_attributes": CAT + NOW + " select manifest, name, pos, size, ts as mtime, ts as ctime, '0644' as mode from cat",
    "oldest_newest": CAT + NOW + " select manifest, min(ts) as oldest, max(ts) as newest from cat group by 1",
    "dir_children_asof": CAT + SNAP + _children("last", ""),
    "dir_children_asof_nested": CAT + SNAP + _children("last", "dev3/"),
    "dir_children_live": CAT + NOW + _children("cat", "dev3/"),
    "calendar_years": "select distinct strftime(ts, '%Y') as year from events",
    "calendar_months": "select distinct strftime(ts, '%Y') as year, strftime(ts, '%m') as month from events where year(ts) = 2024",
    "calendar_days": "select distinct strftime(ts, '%Y') as year, strftime(ts, '%m') as month, strftime(ts, '%d') as day from events where year(ts) = 2024 and month(ts) = 1",
    "calendar_months_orders": "select distinct strftime(o_orderdate, '%Y') as year, strftime(o_orderdate, '%m') as month from orders where year(o_orderdate) = 1995",
    "snapshot_dates": "select distinct strftime(ts, '%Y/%m/%d') as snapshot from events union all select 'latest'",
    "calendar_rollup": "select strftime(ts, '%Y') as year, strftime(ts, '%m') as month, strftime(ts, '%d') as day, count(*) as n from events group by rollup (1, 2, 3)",
    "metadata_by_manifest": CAT + NOW + f" select manifest, {AGGREGATES}, 0::bigint as compressed_size from cat group by 1",
    "metadata_global": CAT + NOW + f" select {AGGREGATES} from cat",
    "bytes_by_day": CAT + "d as (select strftime(ts, '%Y-%m-%d') as day, count(*) as n, sum(size)::bigint as bytes from cat group by 1) select *, (sum(bytes) over (order by day))::bigint as total_bytes from d",
    "dir_stats": CAT + FILES + ", g as (select regexp_extract(path, '^(.*)/', 1) as dir, count(*) as n from f group by 1) select min(n) as min_files, max(n) as max_files, count(*) as dirs from g",
    "next_inode": "select (greatest(coalesce(max(event_id), 0), 500) + 1)::decimal(20,0) as next_inode from events",
    "registry_size": "select count(*) as size from events",
    "registry_lookup": "select event_id as inode, concat('dev', user_id::varchar, '/', event_type, '.json') as name from events where event_id = 42",
    "registry_remove": "select event_id as inode from events where event_id % 3 <> 0",
    "cas_target": f"with {DOCS} select *, cast(concat('0x', right(sha, 5)) as bigint) % 100000 as subbucket from d",
    "cas_dedup": f"with {DOCS} select target, min(doc_id) as first_doc, count(*) as refs from d group by 1",
    "cas_put": f"with {DOCS} select min(doc_id) as doc_id, target from d where doc_id % 2 = 1 and target not in (select target from d where doc_id % 2 = 0) group by 2",
    "merge_bucket_keep_new": f"with {DOCS} select doc_id, target from d where doc_id % 2 = 1 or target not in (select target from d where doc_id % 2 = 1)",
    "bucket_fill": CAT + NOW + " select split_part(target, '-', 1)::bigint as bucket, count(distinct target) as blobs, count(*) as refs from cat where target <> '' group by 1",
    "list_buckets": CAT + NOW + " select distinct split_part(target, '-', 1) as bucket, split_part(target, '-', 2) as subbucket from cat where target <> ''",
    "content_join": CAT + NOW + f", {MEMBERS} select l.manifest, l.name, l.target, m.archive from last l join (select member, min(archive) as archive from members group by 1) m on l.target = m.member where l.target <> ''",
    "hash_path_parse": CAT + NOW + " select pos, case when target <> '' then split_part(target, '-', 3) end as sha, case when target <> '' then concat(split_part(target, '-', 1), '/', split_part(target, '-', 2)) end as work, case when target <> '' then concat(split_part(target, '-', 1), '-', split_part(target, '-', 2)) end as zip from cat",
    "hash_name": r"select page_id, concat(regexp_extract(url, '^(.*/)?', 0), sha256(html), regexp_extract(url, '(\.[^./]*)$', 1)) as name from pages",
    "zip_path": CAT + NOW + " select pos, concat('/store/data/', split_part(target, '-', 1), '-', split_part(target, '-', 2), '.zip') as path from cat where target <> ''",
    "hex_digits": "select event_id, greatest(instr('0123456789abcdef', lower(substr(props, 3, 1))) - 1, 0)::bigint as digit from events",
    "path_overlap": CAT + FILES + ", g(dir) as (values ('site1'), ('site1/dev1'), ('site1/dev11'), ('site')) select path, dir from f join g on starts_with(concat(path, '/'), concat(dir, '/')) or starts_with(concat(dir, '/'), concat(path, '/'))",
    "date_validity": "select event_id, try_cast(concat(strftime(ts, '%Y-%m-'), lpad((event_id % 33)::varchar, 2, '0')) as date) is not null as valid from events",
    "day_snapshot_cutoff": "select distinct strftime(ts, '%Y-%m-%d') as day, date_trunc('day', ts) + interval '23:59:59' as cutoff from events",
    "nearest_manifest": CAT + FILES + """, m as (select distinct regexp_extract(path, '^(.*)/', 1) as dir from f where path like '%/dev%7/%' union select distinct split_part(path, '/', 1) from f)
select path, arg_max(dir, length(dir)) as dir from f join m on starts_with(path, concat(dir, '/')) group by 1""",
    "find_entries_asof": CAT + SNAP + " select concat(manifest, '/', name) as path, manifest, name, target, ts from last where target <> ''",
    "boundary_counts": CAT + TREE + " select dir, total, total > 30 as is_over from t",
    "archive_boundaries": _boundaries(30),
    "archive_boundaries_small": _boundaries(4),
    "file_to_boundary": CAT + TREE + """, b as (select x.path, min(case when t.total <= 30 then i end) as top, max(i) as own from x join t using (dir) group by 1)
select b.path, x.dir as boundary, top is not null as include_subdirs from b join x on x.path = b.path and x.i = coalesce(top, own)""",
    "missing_targets": CAT + f"{MEMBERS}, {MISSING} select * from missing",
    "orphans": CAT + f"{MEMBERS}, {ORPHANS} select * from orphan",
    "metadata_mismatch": CAT + f"{COUNTS}, {MISMATCH} select * from mismatch",
    "validate_findings": CAT + FOUND + " select * from found",
    "validate_summary": CAT + FOUND + " select (select count(*) from archives) as archives_checked, count(distinct archive) as archives_with_errors, count(*) as total_errors from found",
    "repair_preview": CAT + FOUND + """ select archive, bool_or(kind in ('missing metadata', 'metadata mismatch')) as metadata_regenerated, count(*) filter (kind = 'orphan') as orphaned_files_removed,
count(*) filter (kind = 'missing target') as missing_entries_fixed, not bool_or(kind in ('corrupted', 'missing manifest')) as repairable from found group by 1""",
    "repair_entries": CAT + f"{MEMBERS} select manifest as archive, pos, name, target from cat where target = '' or exists (select 1 from members m where m.archive = manifest and m.member = target)",
    "repair_members": CAT + f"{MEMBERS} select archive, member from members m where member in ('manifest.json', 'metadata.json') or exists (select 1 from cat c where c.manifest = m.archive and c.target = m.member and c.target <> '')",
    "repair_metadata": CAT + f"{MEMBERS}, k as (select manifest as archive, name, target, size from cat where target = '' or exists (select 1 from members m where m.archive = manifest and m.member = target)) select archive, count(distinct name) as total_file_count, count(distinct target) as target_file_count, sum(size)::bigint as uncompressed_size from k group by 1",
    "archive_member_counts": CAT + f"{MEMBERS} select archive, count(*) as members from members group by 1",
    "manifest_envelope": CAT + NOW + " select manifest, row_number() over (partition by manifest order by pos) - 1 as pos, name, target, size from cat",
    "log_order": CAT + NOW + " select manifest, row_number() over (partition by manifest order by ts, pos) - 1 as seq, pos, name, ts from cat",
    "scan_all": CAT + NOW + " select manifest, name, target, size, ts from cat",
    "dir_children_by_name": CAT + SNAP + ", q as (" + _children("last", "dev3/").lstrip(" ,").replace("r as (", "with r as (", 1) + ") select *, row_number() over (partition by kind order by entry) as place from q",
    "folder_attributes": CAT + NOW + " select distinct manifest, unnest(['', split_part(name, '/', 1)]) as dir, 1::bigint as inode, '0755' as mode from cat",
    "error_join": CAT + FOUND + ", g as (select archive, case when context = '' then kind else concat(kind, ': ', context) end as message from found) select archive, string_agg(message, chr(10) order by message) as errors from g group by 1",
    "repair_summary": CAT + FOUND + """, p as (select archive, bool_or(kind in ('missing metadata', 'metadata mismatch')) as m, count(*) filter (kind = 'orphan') as o,
count(*) filter (kind = 'missing target') as t, not bool_or(kind in ('corrupted', 'missing manifest')) as ok from found group by 1)
select archive, case when not ok then 'not repairable' else concat_ws(', ', case when m then 'metadata regenerated' end, case when o > 0 then concat(o::varchar, ' orphaned removed') end, case when t > 0 then concat(t::varchar, ' missing entries fixed') end) end as summary from p""",
    "content_overlay": r"""with h as (select doc_id, hex(encode(text)) as x, (doc_id % 200)::int as p from documents)
select doc_id, sha256(unhex(concat(rpad(substr(x, 1, 2 * p), 2 * p, '0'), hex(encode('PATCHED')), substr(x, 2 * p + 15)))) as written, sha256(unhex(rpad(substr(x, 1, 600), 600, '0'))) as truncated from h""",
    "validate_altered": CAT + NOW + ", bad as (select distinct c.manifest, c.target from cat c join events e on c.pos = e.event_id where c.pos % 13 = 0 and c.target <> '') select distinct manifest as archive, pos, name from cat semi join bad using (manifest, target)",
    "scan_members": CAT + f"{MEMBERS} select archive, bool_or(member = 'manifest.json') as has_manifest, bool_or(member = 'metadata.json') as has_metadata from members group by 1",
    "own_files": CAT + f"{MEMBERS} select archive, count(*) as kept from members where member not in ('manifest.json', 'metadata.json') group by 1",
    "path_depth": CAT + FILES + " select path, len(string_split(path, '/')) - 1 as depth, path like '%.zip' as is_archive from f",
    "seed_shape": SEED + " select name, ts, concat((cast(concat('0x', substr(sha256(content), 1, 4)) as bigint) % 1000)::varchar, '-00000-', sha256(content)) as target from files",
    "seed_by_depth": SEED + " select len(string_split(folder, '/')) as depth, count(*) as files, count(distinct content) as contents from files group by 1",
}

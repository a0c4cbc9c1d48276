"""SQL twins of the registered queries, for a second engine to check results against.

Written apart from the operators: RE2 patterns, offsets counted from gaps, joins instead of
row-local arrays, and plain windows over whole diffs.
"""

from __future__ import annotations

import re

from credsieve.plans import corpus as C
from credsieve.plans.catalog import BOUNDARY_RULES, GROUPED, user_config
from credsieve.config import default_settings
from credsieve.rules import SKIPPED_SUFFIXES

SPACES = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_END = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
TOKEN = rf"[^{SPACES}''\"`,;(){{}}\[\]<>\\/=:]"
# Characters of a match that follow its capture group.
AFTER_GROUP = {"aws-secret-access-key": 0, "generic-secret-assignment": 1, "bearer-token": 0, "corpus-token": 1}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    def in_class(m: re.Match) -> str:
        return m.group().replace(r"\s", SPACES)

    pattern = re.sub(r"\[(?:\\.|[^\]\\])*\]", in_class, pattern)
    return pattern.replace(r"\s", f"[{SPACES}]")


# --- inputs ----------------------------------------------------------------------------------


def lines_sql(path: str, text: str, source: str) -> str:
    return f"""
      select file_path, cast(n as integer) as line_number, parts[n] as content from (
        select file_path, case when parts[len(parts)] = '' then parts[1:len(parts) - 1] else parts end as parts
        from (select {path} as file_path, string_split_regex({text}, {quoted(LINE_END)}) as parts from {source}) as split_up
      ) as cut, unnest(generate_series(1, len(parts))) as numbered(n)"""


DOCUMENT_PATH = "source || '/' || doc_id || '.txt'"
DOCUMENTS = lines_sql(DOCUMENT_PATH, "text", "documents")
PAGES = lines_sql("url", "html", "pages")
CONVERSATIONS = lines_sql("conv_id || '/' || turn", "text", "conversations")
CORPUS = " union all ".join([DOCUMENTS, PAGES, CONVERSATIONS, C.ORDER_LINES_SQL])


def ignored_sql(path: str, extra: str = "false") -> str:
    folders = [
        "node_modules", "vendor", ".venv", "venv", ".env", "site-packages", "dist", "build",
        "__pycache__", ".git", "coverage", ".nyc_output", "bower_components",
    ]
    files = ["package-lock.json", "pnpm-lock.yaml", "go.sum", "Cargo.lock"]
    tests = [f"contains('/' || {path}, '/{f}/')" for f in folders]
    tests += [f"ends_with('/' || {path}, '/{f}')" for f in files]
    return "(" + " or ".join([*tests, extra]) + ")"


USER_IGNORED = "{p} like 'svc7/%' or ends_with('/' || {p}, '/none.md')"


def user_ignored(path: str) -> str:
    return ignored_sql(path, USER_IGNORED.format(p=path))


# --- detection -------------------------------------------------------------------------------


def mask(v: str) -> str:
    return (
        f"case when length({v}) <= 4 then '****' "
        f"when length({v}) <= 7 then left({v}, 4) || '***' "
        f"when length({v}) <= 11 then left({v}, 4) || repeat('*', length({v}) - 4) "
        f"else left({v}, 4) || repeat('*', length({v}) - 8) || right({v}, 4) end"
    )


def redact(line: str, s: str, e: str) -> str:
    value = f"substring({line}, {s} + 1, {e} - {s})"
    return (
        f"case when {s} < 0 or {e} > length({line}) or {s} >= {e} then {line} "
        f"else left({line}, {s}) || ({mask(value)}) || substring({line}, {e} + 1) end"
    )


def print_of(rule: str, path: str, masked: str) -> str:
    return f"left(sha256({rule} || ':' || {path} || ':' || {masked}), 16)"


def entropy(text: str) -> str:
    return (
        f"case when length({text}) = 0 then 0.0 else log2(length({text})) - "
        f"list_sum(list_transform(list_distinct(string_split({text}, '')), lambda c: "
        f"(length({text}) - length(replace({text}, c, ''))) * log2(length({text}) - length(replace({text}, c, ''))))) "
        f"/ length({text}) end"
    )


def spans_sql(pattern: str, source: str, group: int = 0, after: int = 0) -> str:
    p = quoted(pattern)
    return f"""
      select lid, v[i] as raw_value,
             cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
                  + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) as integer) - {after} as column_end
      from (select lid, string_split_regex(content, {p}) as g, regexp_extract_all(content, {p}, 0) as m,
                   regexp_extract_all(content, {p}, {group}) as v
            from {source} where regexp_matches(content, {p})) as hit, unnest(generate_series(1, len(m))) as nth(i)"""


def regex_hits(rules, source: str = "lines") -> str:
    parts = []
    for i, r in enumerate(rules):
        group = 1 if r.id in AFTER_GROUP else 0
        parts.append(
            f"select {i} as rule_ord, {quoted(r.id)} as rule_id, {quoted(r.name)} as rule_name, '{r.severity}' as severity, "
            f"'regex' as match_type, 0 as engine_rank, lid, raw_value, cast(column_end - length(raw_value) as integer) as column_start, column_end "
            f"from ({spans_sql(re2(r.pattern), source, group, AFTER_GROUP.get(r.id, 0))}) as found"
        )
    return " union all ".join(parts)


def entropy_hits(threshold: float, source: str = "lines") -> str:
    kept, hexes = ("regexp_replace(raw_value, '[^A-Za-z0-9+/=]', '', 'g')", "regexp_replace(raw_value, '[^0-9a-fA-F]', '', 'g')")
    return f"""
      select 0 as rule_ord, 'high-entropy-string' as rule_id, 'High Entropy String' as rule_name, 'medium' as severity,
             'entropy' as match_type, 1 as engine_rank, lid, raw_value, cast(column_end - length(raw_value) as integer) as column_start, column_end
      from ({spans_sql(TOKEN.replace("''", "'") + '+', source)}) as found
      where length(raw_value) between 20 and 256
        and greatest({entropy(kept)}, {entropy(hexes)}) >= {threshold} - 1e-9"""


def hits_ctes(rules, threshold: float | None, extra: str = "") -> str:
    """CTEs ``rx``, ``en`` and ``hits`` over ``lines(lid, file_path, line_number, content)``."""
    rx = regex_hits(rules) + (f" union all {extra}" if extra else "")
    en = entropy_hits(threshold) if threshold else None
    out = f"rx as materialized ({rx})"
    if en:
        out += f""", en as materialized ({en}), hits as materialized (
          select * from rx union all
          select * from en where not exists (select 1 from rx where rx.lid = en.lid
            and en.column_start < rx.column_end and en.column_end > rx.column_start))"""
    else:
        out += ", hits as (select * from rx)"
    return out


def numbered(source: str) -> str:
    return f"lines as materialized (select row_number() over () as lid, * from ({source}) as every_line)"


ALLOWED = "regexp_matches(raw_value, 'EXAMPLE$') or regexp_matches(raw_value, '(?i)^placeholder')"


def scan_ctes(
    source: str = CORPUS, *, rules=None, threshold: float = 4.5, ignored=user_ignored, allowed: str = ALLOWED,
    mode: str = "working_tree", baseline: str | None = None, extra: str = "", columns: str = "",
) -> str:
    """CTEs up to ``matches``; ``all_lines`` holds ignored lines too."""
    rules = user_config().rules if rules is None else rules
    known = f"fingerprint in ({baseline})" if baseline else "false"
    return f"""with all_lines as materialized ({source}),
      {numbered(f"select * from all_lines where not {ignored('file_path')}")},
      {hits_ctes(rules, threshold, extra)},
      masked as (select h.*, l.* exclude (lid), {mask('h.raw_value')} as secret_masked from hits h join lines l on h.lid = l.lid),
      printed as (select *, {print_of('rule_id', 'file_path', 'secret_masked')} as fingerprint from masked),
      matches as materialized (
        select fingerprint, rule_id, rule_name, severity, match_type, file_path, line_number, column_start, column_end,
               secret_masked, {redact('content', 'column_start', 'column_end')} as line_preview, '{mode}' as scan_mode,
               cast(null as varchar) as commit_hash, {columns or 'cast(null as varchar)'} as author, engine_rank, rule_ord, lid, content,
               case when {allowed} then 'allowlist' when {known} then 'baseline' else 'kept' end as status
        from printed),
      kept as (select * from matches where status = 'kept')"""


FINDING = (
    "fingerprint, rule_id, rule_name, severity, match_type, file_path, line_number, column_start, column_end, "
    "secret_masked, line_preview, scan_mode, commit_hash, author"
)
DEFAULTS = dict(rules=default_settings().rules, ignored=ignored_sql, allowed="false")
# Fingerprints of all findings of a default scan of the order lines below an application folder.
HALF_BASELINE = (
    f"select fingerprint from ({scan_ctes(C.ORDER_LINES_SQL, **DEFAULTS)} select * from kept where ends_with(file_path, '.py')) as known"
)

# Lines with every span masked: overlapping spans are merged with a running maximum, then the
# gaps and the masks are strung together.
SAFE = f"""
  spans as (select lid, column_start as s, column_end as e from hits),
  marked as (select *, max(e) over (partition by lid order by s, e rows between unbounded preceding and 1 preceding) as before from spans),
  grouped as (select *, sum(case when before is null or s >= before then 1 else 0 end) over (partition by lid order by s, e) as grp from marked),
  merged as (select lid, grp, min(s) as s, max(e) as e from grouped group by lid, grp),
  pieces as (select m.lid, m.s, m.e, l.content, coalesce(lag(m.e) over (partition by m.lid order by m.s), 0) as done,
                    substring(l.content, m.s + 1, m.e - m.s) as v from merged m join lines l on l.lid = m.lid),
  safe as (select lid, string_agg(substring(content, done + 1, s - done) || ({mask('v')}), '' order by s)
                  || substring(any_value(content), max(e) + 1) as safe_preview from pieces group by lid)"""

SHOWN = "file_path, line_number, rule_id, severity, match_type, sha256(raw_value) as value_sha, column_start, column_end"


def hits_only(rules, threshold: float | None) -> str:
    return f"""with {numbered(CORPUS)}, {hits_ctes(rules, threshold)}
      select {SHOWN} from hits join lines using (lid)"""


COUNTS = """cast(count(*) filter (where status = 'kept') as bigint) as total,
  cast(count(*) filter (where status = 'kept' and severity = 'critical') as bigint) as critical,
  cast(count(*) filter (where status = 'kept' and severity = 'high') as bigint) as high,
  cast(count(*) filter (where status <> 'kept') as bigint) as suppressed"""


def summary_sql(ctes: str) -> str:
    return f"""{ctes} select 'working_tree' as scan_mode, 'corpus' as target, c.*, f.* from
      (select {COUNTS} from matches) as c,
      (select count(distinct file_path) filter (where not {user_ignored('file_path')}) as scanned_files,
              count(*) as scanned_lines from all_lines) as f"""


LEVEL = "case severity when 'critical' then 'error' when 'high' then 'error' when 'low' then 'note' else 'warning' end"
RANK = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"
ORDER = "file_path, line_number, engine_rank, rule_ord, column_start"
FIRST = f"""select *, row_number() over (partition by rule_id order by {ORDER}) as nth,
  count(*) over (partition by rule_id) as findings from kept"""

# --- diffs -----------------------------------------------------------------------------------

DIFFS = f"with sections as (select *, unnest(range({C.DIFF_PARTS})) as j from orders) {C.DIFF_LINES_SQL}"
ADDED = f"""
  select diff_id, seq, file_path, cast(line_number as integer) as line_number, raw[2:] as content from (
    select *, ups - coalesce(max(case when resets then ups end) over (partition by diff_id, leg), 0)
              + coalesce(max(case when resets then restart end) over (partition by diff_id, leg), 0) as line_number
    from (
      select *, sum(case when kind = 'context' or (kind = 'added' and coalesce(file_path, '') <> '') then 1 else 0 end)
                  over (partition by diff_id order by seq) as ups,
                count(*) filter (where resets) over (partition by diff_id order by seq) as leg
      from (
        select *, max(case when opens then path end) over (partition by diff_id, file_no) as file_path
        from (
          select *, count(*) filter (where opens) over (partition by diff_id order by seq) as file_no
          from (
            select *, kind in ('header', 'new') as opens, kind in ('header', 'hunk') as resets,
                   case kind when 'header' then case when contains(raw, ' b/') then trim(substring(raw, position(' b/' in raw) + 3)) end
                             when 'new' then trim(raw[7:], chr(9) || ' ') end as path,
                   case kind when 'header' then 0 when 'hunk' then
                     coalesce(try_cast(regexp_extract(raw, '^@@ [^+]*[+]([0-9]+)', 1) as integer) - 1, 0) end as restart
            from (
              select *, case when starts_with(raw, 'diff --git ') then 'header' when starts_with(raw, '+++ b/') then 'new'
                             when starts_with(raw, '+++ /dev/null') or starts_with(raw, '--- ') then 'name'
                             when starts_with(raw, '@@ ') then 'hunk'
                             when starts_with(raw, '+') and not starts_with(raw, '+++') then 'added'
                             when starts_with(raw, '-') then 'removed' else 'context' end as kind
              from ({DIFFS}) as diff_text) as classed) as opened) as filed) as carried) as counted) as placed
  where kind = 'added' and coalesce(file_path, '') <> ''
    and not list_contains({SKIPPED_SUFFIXES!r}, lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)))"""
AUTHORS = f"""select file_path, arg_max(author, struct_pack(t := commit_ts, a := author)) as author
  from ({C.COMMITS_SQL}) as commits group by file_path"""
RANGE_AUTHORS = AUTHORS.replace("group by file_path", f"where author not in {tuple(C.EARLIER_AUTHORS)} group by file_path")


def document_files() -> str:
    return (
        "select source || '/d' || doc_id || ['.txt', '.PNG', '.lock', '.tar.gz', '.py', '/.lock', '/Makefile'][doc_id % 7 + 1] "
        "as file_path, cast(strlen(text) as bigint) as length, text from documents"
    )


SUFFIX = "lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1))"
DOC_IGNORED = (
    "ends_with(file_path, '.env') or file_path = 'x.js' or ends_with('/' || file_path, '/x.js') or ends_with(file_path, '.go') "
    "or regexp_matches(file_path, '^svc./docs/') or regexp_matches(file_path, '^[a-c].*/1.*\\.txt$')"
)
EVENT_SCAN = scan_ctes(C.EVENT_LINES_SQL, mode="staged")
EVENT_LINES = C.EVENT_LINES_SQL.replace(", ts from", " from")
RULE_ROWS = ", ".join(
    f"({i}, {quoted(r.id)}, {quoted(r.name)}, '{r.severity}', {quoted(r.description or '—')})"
    for i, r in enumerate(user_config().rules)
)
HOST_HITS = f"""select 0 as rule_ord, 'internal-host' as rule_id, 'Internal Host' as rule_name, 'low' as severity,
  'regex' as match_type, 2 as engine_rank, lid, raw_value, cast(column_end - length(raw_value) as integer) as column_start, column_end
  from ({spans_sql('db[0-9]+[.]example[.]com', 'lines')}) as hosts"""
SARIF_MESSAGE = "rule_name || ' found, masked as ' || secret_masked || '; revoke it and issue a new one'"
TREE_PATH = "'.conf/text/svc=' || split_part(file_path, '/', 1)"


def tree_findings(where: str = "true") -> str:
    source = f"select {TREE_PATH} as file_path, line_number, content from ({C.ORDER_LINES_SQL}) as o where {where}"
    return scan_ctes(source, **DEFAULTS)


ORACLE_SQL: dict[str, str] = {
    "lines_documents": DOCUMENTS,
    "lines_pages": PAGES,
    "lines_conversations": CONVERSATIONS,
    "file_suffix": f"select file_path, split_part(file_path, '/', -1) as name, {SUFFIX} as suffix from ({document_files()}) as f",
    "file_selection": f"select file_path, length from ({document_files()}) as f where length <= 4096 and not list_contains({SKIPPED_SUFFIXES!r}, {SUFFIX})",
    "decode_files": f"select file_path, 'a' || chr(65533) || 'b' || text || chr(65533) as text from ({document_files()}) as f",
    "manifest_files": f"select {DOCUMENT_PATH} as file_path, cast(length(text) as integer) as n_chars from documents where doc_id in (select doc_id from labels)",
    "tree_scan": f"{tree_findings()} select file_path as folder, rule_id, count(*) as findings from kept group by all",
    "subtree_scan": f"""{tree_findings("split_part(file_path, '/', 1) = 'svc4'")} select rule_id, count(*) as findings from kept group by all""",
    "mask_secret": f"select id, {mask('value')} as masked from (select o_orderkey as id, substring(repeat(md5(cast(o_orderkey as varchar)), 2), 1, o_orderkey % 41) as value from orders) as v",
    "redact_line": f"select file_path, line_number, {redact('content', 's', 'e')} as line_preview from (select *, line_number % 23 - 2 as s, line_number % 57 - 3 as e from ({C.ORDER_LINES_SQL}) as o) as spans",
    "redact_all_spans": f"with {numbered(CORPUS)}, {hits_ctes(default_settings().rules, 4.5)}, {SAFE} "
    "select file_path, line_number, cast(coalesce(n, 0) as integer) as n_hits, coalesce(safe_preview, content) as safe_preview "
    "from lines left join safe using (lid) left join (select lid, count(*) as n from hits group by lid) as c using (lid)",
    "fingerprint": f"select line_number, {print_of(quoted('rule'), 'file_path', '(' + mask('content') + ')')} as fingerprint from ({C.ORDER_LINES_SQL}) as o",
    "preview": f"select file_path, line_number, left(regexp_replace(' ' || chr(9) || content || '  ', {quoted(f'^[{SPACES}]+|[{SPACES}]+$')}, '', 'g'), 80) as preview from ({CORPUS}) as c",
    "ignored_paths": f"select file_path, {ignored_sql('file_path', DOC_IGNORED)} as ignored from (select file_path from ({C.ORDER_LINES_SQL}) as o union all select {DOCUMENT_PATH} from documents) as p",
    "regex_matches": hits_only(default_settings().rules, None),
    "user_rules_word_boundary": hits_only(BOUNDARY_RULES, None),
    "regex_on_arrow": hits_only(default_settings().rules, None),
    "capture_groups": hits_only([r for r in user_config().rules if r.id in GROUPED], None),
    "tokens": f"with {numbered(CORPUS)} select file_path, line_number, raw_value as token, column_end - cast(length(raw_value) as integer) as column_start, column_end "
    f"from ({spans_sql(TOKEN.replace(chr(39) * 2, chr(39)) + '+', 'lines')}) as t join lines using (lid)",
    "entropy_hits": f"with {numbered(CORPUS)}, hits as materialized ({entropy_hits(3.5)}) select {SHOWN} from hits join lines using (lid)",
    "overlap_suppression": hits_only(default_settings().rules, 3.5),
    "custom_detector": f"{scan_ctes(extra=HOST_HITS)} select file_path, line_number, rule_id, severity, column_start, column_end, secret_masked from kept",
    "findings_default": f"{scan_ctes(**DEFAULTS)} select {FINDING} from kept",
    "findings_custom": f"{scan_ctes()} select {FINDING} from kept",
    "findings_sensitive": f"{scan_ctes(threshold=3.5)} select {FINDING} from kept",
    "rules_from_tables": f"{scan_ctes()} select rule_ord, rule_id, severity, file_path, line_number, fingerprint from matches",
    "match_status": f"{scan_ctes(baseline=HALF_BASELINE)} select fingerprint, file_path, line_number, column_start, status from matches",
    "allowlist": scan_ctes(
        ignored=lambda p: ignored_sql(p, f"{p} like 'svc7/%'"),
        allowed="regexp_matches(raw_value, 'EXAMPLE$|^AKIA[0-4]|ab') or regexp_matches(raw_value, '(?i)DB1[0-9]*[.]example')",
    )
    + " select rule_id, status, count(*) as matches from matches group by all",
    "path_filter": f"select file_path, count(*) as lines from ({CORPUS}) as c where not {user_ignored('file_path')} group by all",
    "baseline_create": f"{scan_ctes()} select distinct fingerprint from kept",
    "baseline_suppress": f"{scan_ctes()} select fingerprint, rule_id, file_path, line_number from kept where fingerprint not in ({HALF_BASELINE})",
    "baseline_roundtrip": f"select scan_mode, target, cast(0 as bigint) as total, cast(0 as bigint) as critical, cast(0 as bigint) as high, "
    f"total + suppressed as suppressed, scanned_files, scanned_lines from ({summary_sql(scan_ctes())}) as s",
    "summary": summary_sql(scan_ctes()),
    "summary_with_baseline": summary_sql(scan_ctes(baseline=HALF_BASELINE)),
    "by_severity": f"{scan_ctes()} select severity, count(*) filter (where status = 'kept') as findings, count(*) filter (where status <> 'kept') as suppressed from matches group by all",
    "severity_levels": f"{scan_ctes()} select severity, {RANK} as rank, {LEVEL} as level, count(*) as findings from kept group by all",
    "first_per_rule": f"{scan_ctes()} select rule_id, rule_name, severity, match_type, file_path, line_number, column_start, findings from ({FIRST}) as f where nth = 1",
    "gate": f"{scan_ctes()} select count(*) > 0 as has_findings, cast(count(*) > 0 as integer) as exit_code from kept",
    "findings_view": f"{scan_ctes()} select upper(severity) as severity, rule_name as rule, file_path as file, line_number as line, "
    f"replace(secret_masked, '*', '•') as secret, left(regexp_replace(line_preview, {quoted(f'^[{SPACES}]+|[{SPACES}]+$')}, '', 'g'), 80) as preview from kept",
    "rule_activity": f"{scan_ctes()} select r.*, count(m.rule_id) as hits, count(m.rule_id) filter (where m.status = 'kept') as findings "
    f"from (values {RULE_ROWS}) as r(rule_ord, id, name, severity, description) left join matches m on m.rule_id = r.id group by all",
    "json_findings": f"{scan_ctes()}, {SAFE} select cast(to_json(f) as varchar) as value from (select {FINDING.replace('line_preview', 'safe_preview as line_preview')} from kept join safe using (lid)) as f",
    "json_summary": "select cast(to_json(j) as varchar) as value from (select scan_mode, target, {'total': total, 'critical': critical, 'high': high, 'suppressed': suppressed, "
    f"'scanned_files': scanned_files, 'scanned_lines': scanned_lines}} as summary from ({summary_sql(scan_ctes())}) as s) as j",
    "json_documents": f"{scan_ctes()} select 'corpus' as target, (select count(*) from kept) as total, (select count(*) from matches where status <> 'kept') as suppressed, "
    "fingerprint, file_path, line_number, column_start from kept",
    "sarif_results": f"{scan_ctes()}, {SAFE} select rule_id as \"ruleId\", {LEVEL} as level, {SARIF_MESSAGE} as message, file_path as uri, line_number as \"startLine\", "
    "column_start + 1 as \"startColumn\", column_end + 1 as \"endColumn\", safe_preview as snippet, fingerprint, severity, match_type as \"matchType\", "
    "secret_masked as \"secretMasked\", author, commit_hash as \"commitHash\" from kept join safe using (lid)",
    "sarif_rules": f"{scan_ctes()} select rule_id as id, rule_name as name, 'credsieve: ' || match_type || ' rule ' || rule_id as \"fullDescription\", "
    f"{LEVEL} as level, severity, match_type as \"matchType\" from ({FIRST}) as f where nth = 1",
    "sarif_documents": f"{scan_ctes()} select '2.1.0' as version, (select count(*) from matches where status <> 'kept') as suppressed, rule_id, true as rule_listed, "
    f"{LEVEL} as level, file_path as uri, line_number as start_line, column_start + 1 as start_column from kept",
    "diff_added_lines": ADDED,
    "author_map": AUTHORS,
    "staged_scan": f"{scan_ctes(f'select file_path, line_number, content from ({ADDED}) as a', mode='staged')} select {FINDING} from kept",
    "commit_range_scan": scan_ctes(
        f"select a.file_path, line_number, content, w.author from ({ADDED}) as a left join ({RANGE_AUTHORS}) as w on a.file_path = w.file_path where a.diff_id % 5 <> 0",
        mode="commit_range",
        columns="author",
    )
    + f" select {FINDING} from kept",
    "stream_scan": scan_ctes(f"{DOCUMENTS} union all {EVENT_LINES}", mode="staged") + f" select {FINDING} from kept",
    "stream_baseline": f"{EVENT_SCAN} select fingerprint, rule_id, file_path, line_number from kept where not (contains(file_path, 'view') and fingerprint in "
    f"(select fingerprint from ({scan_ctes(C.EVENT_LINES_SQL, **DEFAULTS)} select * from kept) as known))",
    "stream_dedup": f"{EVENT_SCAN} select distinct fingerprint, rule_id, file_path, secret_masked from kept",
}
_KEPT = "regexp_replace(raw_value, '[^A-Za-z0-9+/=]', '', 'g')"
_HEX = "regexp_replace(raw_value, '[^0-9a-fA-F]', '', 'g')"
# With the entropy detector off there are the same rules' matches and no others.
ORACLE_SQL["settings_file"] = f"{scan_ctes()} select {FINDING} from kept where match_type = 'regex'"
ORACLE_SQL["rule_listing"] = f"select *, false as entropy_enabled, 4.2::double as entropy_threshold from ({ORACLE_SQL['rule_activity']}) as r"
ORACLE_SQL["sarif_report"] = ORACLE_SQL["sarif_documents"]
ORACLE_SQL["json_report"] = (
    f"select s.target, total, critical, high, suppressed, scanned_files, scanned_lines, fingerprint, file_path, line_number, column_start "
    f"from ({scan_ctes()} select fingerprint, file_path, line_number, column_start from kept) as f cross join ({summary_sql(scan_ctes())}) as s"
)
ORACLE_SQL["stream_following"] = ORACLE_SQL["stream_baseline"]
ORACLE_SQL["tree_stream"] = ORACLE_SQL["tree_scan"]
ORACLE_SQL["baseline_table_roundtrip"] = ORACLE_SQL["baseline_roundtrip"]
ORACLE_SQL["entropy_scores"] = f"""with {numbered(CORPUS)},
  scored as (select lid, column_end - cast(length(raw_value) as integer) as column_start, {entropy(_KEPT)} as b, {entropy(_HEX)} as h
             from ({spans_sql(TOKEN.replace("''", "'") + '+', 'lines')}) as t where length(raw_value) between 20 and 256)
  select file_path, line_number, column_start, round(greatest(b, h), 6) as entropy,
         case when b >= h - 1e-9 then 'base64' else 'hex' end as charset from scored join lines using (lid)"""

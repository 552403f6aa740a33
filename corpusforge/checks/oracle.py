"""Equivalent SQL of every query, runnable by DuckDB on the same tables as one statement."""

from corpusforge import fixed_values as fv
from corpusforge.checks import queries as q
from corpusforge.checks import sqltext as t
from corpusforge.checks import structure_sql as ss
from corpusforge.checks.corpora import DOCS, sql_ctes
from corpusforge.checks.sqltext import NL, joined, lit, lines, splitlines, starts, strip, where

CORPORA = sql_ctes()
K = "corpus_id, path"


def select(columns: dict[str, str], source: str = "documents") -> str:
    return f"select {', '.join(f'{e} as {n}' for n, e in columns.items())} from {source}"


def statement(body: str, *needed: str, **ctes: str) -> str:
    """WITH list: the corpora in ``needed`` (all those that ``files`` unites come with it), then ``ctes``."""
    names = [n for n in CORPORA if n in needed or ("files" in needed and n != "mods_old")]
    parts = {**{n: CORPORA[n] for n in names}, **ctes}
    listed = ", ".join(f"{n} as ({s})" for n, s in parts.items())
    return f"with {listed} {body}" if parts else body


PROSE = "select * from docs union all select * from sites"


def typed(source: str) -> dict[str, str]:
    return {"typed": f"select *, {t.file_type('path')} as file_type, strlen(content) as original_size from {source}"}


def level_ctes(source: str, level: str) -> dict[str, str]:
    """``shown``: reduced rows of one level, with measures."""
    kind = "file_type"
    python_skeleton = level in ("aggressive", "smart")
    code = f"({t.among(kind, fv.SMART_CODE_TYPES)} and original_size > 256)"
    route = {"smart": f"case when {code} then case when original_size > 10000 then 'aggressive' when original_size > 1000 then 'medium' else 'light' end "
                      f"when original_size > 5000 then 'aggressive' when original_size > 500 then 'medium' else 'light' end"}.get(level, lit(level))
    routed = route if level == "none" else f"case when {t.blank('content')} then 'blank' else {route} end"
    ctes = {**typed(source), "routed": f"select *, {routed} as route from typed"}
    skeleton, join = "null", ""
    if python_skeleton:
        ctes["modules"] = "select corpus_id, path, content from routed where route = 'aggressive' and file_type = 'python'"
        ctes.update(ss.statement_ctes("modules", "st"))
        ctes.update(ss.owner_ctes("st"))
        ctes.update(ss.skeleton_ctes("st"))
        skeleton, join = "skeleton", "left join st_skel using (corpus_id, path)"
    rough = f"coalesce({t.signatures('content', kind)}, {t.regex_medium('content', kind)})"
    text = {"none": "content", "light": t.light("content"), "medium": t.medium("content", kind)}
    wanted = {"smart": ["light", "medium", "aggressive"]}.get(level, [level])
    cases = " ".join(f"when route = {lit(w)} then {text[w]}" for w in wanted if w in text)
    if "aggressive" in wanted:
        cases += (f" when file_type = 'python' then coalesce({skeleton}, {text['medium']}) else {rough}")
    methods = {"none": fv.METHOD_NONE, "light": fv.METHOD_LIGHT, "medium": fv.METHOD_MEDIUM}
    named = " ".join(f"when route = {lit(r)} then {lit(m)}" for r, m in methods.items())
    prefix = "smart->" if level == "smart" else ""
    method = (f"case when route = 'blank' then {lit(fv.METHOD_BLANK)} else {lit(prefix)} || case {named} "
              f"when file_type = 'python' and {skeleton} is null then {lit(fv.METHOD_MEDIUM)} "
              f"else 'aggressive (' || file_type || '-ast)' end end")
    ctes["reduced"] = f"select *, case when route = 'blank' then '' {cases} end as reduced, {method} as method from routed {join}"
    ctes["cleaned"] = f"select *, {t.cleaned('reduced', kind)} as clean, strlen(reduced) as reduced_size from reduced"
    ctes["shown"] = (f"select corpus_id, path, content, reduced, file_type, method, sha256(reduced) as reduced_sha, original_size, reduced_size, "
                     f"{t.tokens('clean', 'reduced', kind)} as tokens, case when reduced_size > 0 then original_size / reduced_size "
                     f"when original_size = 0 or route = 'blank' then 1e0 else cast('inf' as double) end as ratio, {lit(level)} as level from cleaned")
    return ctes


_SHOWN = "select corpus_id, path, file_type, method, reduced_sha, original_size, reduced_size, tokens, ratio from shown"


def _level(level: str, source: str) -> str:
    if source == "prose":
        return statement(_SHOWN, "docs", "sites", prose=PROSE, **level_ctes("prose", level))
    return statement(_SHOWN, source, **level_ctes(source, level))


def _unavailable(level: str) -> str:
    """Levels without a model: code that the aggressive level shrinks enough is kept by smart, the size tiers decide the rest."""
    missing = f"{fv.METHOD_SEMANTIC}-unavailable, fallback to "
    rough = {f"rough_{n}" if n == "shown" else n: s for n, s in level_ctes("prose", "aggressive").items()}
    inner = ", ".join(f"{n} as ({s})" for n, s in rough.items() if not n.startswith("rough_"))
    rough_shown = f"with {inner} {rough['rough_shown']}"
    plain = f"method = {lit(fv.METHOD_BLANK)}"
    if level == "semantic":
        return statement(_SHOWN.replace("method,", f"case when {plain} then method else {lit(missing)} || method end as method,"),
                         "docs", "sites", prose=PROSE, shown=rough_shown)
    code = f"{t.among('file_type', fv.SMART_CODE_TYPES)} and original_size > {fv.SMART_SEMANTIC_MIN_BYTES}"
    tiers_inner = ", ".join(f"{n} as ({s})" for n, s in level_ctes("prose", "smart").items())
    kept = f"select * from rough where {code} and not ({plain}) and ratio > {fv.SMART_SEMANTIC_MIN_RATIO}"
    rows = (f"select * replace ('smart->' || {lit(missing)} || method as method) from kept union all "
            "select * from tiers where (corpus_id, path) not in (select (corpus_id, path) from kept)")
    return statement(_SHOWN, "docs", "sites", prose=PROSE, rough=rough_shown, tiers=f"with {tiers_inner} select * from shown", kept=kept, shown=rows)


def _summary() -> str:
    selects = []
    for level in ("none", "light", "medium", "aggressive"):
        inner = ", ".join(f"{n} as ({s})" for n, s in level_ctes("files", level).items())
        selects.append(f"(with {inner} select level, file_type, original_size, reduced_size, tokens from shown)")
    return statement("select level, file_type, count(*) as n_files, cast(sum(original_size) as bigint) as original_bytes, "
                     "cast(sum(reduced_size) as bigint) as reduced_bytes, cast(sum(tokens) as bigint) as tokens "
                     f"from ({' union all '.join('select * from ' + s for s in selects)}) group by level, file_type", "files")


def _signature(*names: str) -> str:
    union = "select * from docs" + "".join(f" union all select * from twin_{n}" for n in names)
    return statement(f"select corpus_id, path, file_type, sha256(skeleton) as skeleton_sha, length(skeleton) as n_chars "
                     f"from (select *, {t.signatures('content', 'file_type')} as skeleton from typed) where skeleton is not null",
                     "docs", *[f"twin_{n}" for n in names], src=union, **typed("src"))


def _structure(body: str, version: str = "new", extra=None) -> str:
    source = f"mods_{version}"
    return statement(body, source, **ss.statement_ctes(source, "st"), **(extra or {}))


def normalise(path: str) -> str:
    """Fold over the parts, kept as one string with '/' before each part."""
    absolute = f"starts_with({path}, '/')"
    step = (f"case when y = '' or y = '.' then x when y = '..' and x <> '' and not (x = '/..' or x like '%/..') then regexp_replace(x, '/[^/]*$', '') "
            f"when y = '..' and {absolute} then x else x || '/' || y end")
    kept = f"list_reduce(list_prepend('', string_split({path}, '/')), lambda x, y: {step})"
    body = f"substr({kept}, 2)"
    lead = f"case when {t.has(path, '^//([^/]|$)')} then '//' when {absolute} then '/' else '' end"
    return f"coalesce(nullif({lead} || {body}, ''), '.')"


def _fenced() -> str:
    raw = strip("raw_text")

    def inside(n):
        body = strip(f"substr({raw}, {n})")
        return f"case when ends_with({body}, '```') then {strip(f'left({body}, length({body}) - 3)')} else {body} end"

    return f"case when starts_with({raw}, '```json') then {inside(8)} when starts_with({raw}, '```') then {inside(4)} else {raw} end"


def _ingest() -> str:
    cut = ("case when starts_with(x, chr(123)) then x when position(chr(123) in x) > 0 then case when length(x) - position(chr(125) in reverse(x)) + 1 > position(chr(123) in x) "
           "and contains(x, chr(125)) then substr(x, position(chr(123) in x), length(x) - position(chr(125) in reverse(x)) + 1 - position(chr(123) in x) + 1) else x end end")
    usable = "(case when json_valid(js) then json_type(js) = 'OBJECT' else false end)"

    def absent(key):
        return f"(json_extract(case when json_valid(js) then js end, '$.{key}') is null)::int"

    count = " + ".join(absent(k) for k in fv.RESPONSE_KEYS)
    method = (f"case when {t.blank('r.content')} then {lit(fv.METHOD_BLANK)} when {usable} then 'semantic-llm' "
              f"else 'semantic-llm-failed, fallback to ' || m.method end")
    return statement(
        f"select r.corpus_id, r.path, case when {usable} then {count} else 0 end as n_missing_keys, {usable} as usable, "
        f"case when {usable} then coalesce(json_extract_string(case when json_valid(js) then js end, '$.file_path'), r.path) end as file_path, "
        f"case when {usable} then coalesce(json_extract_string(case when json_valid(js) then js end, '$.overall_purpose'), '') end as purpose, "
        f"case when {usable} then '[]' end as imports, case when {usable} then coalesce(json_extract(case when json_valid(js) then js end, '$.key_components.configuration')::varchar, '') end as configuration, "
        f"{method} as method from (select *, {cut} as js from fenced) r join shown m using (corpus_id, path)",
        "docs", fenced=f"select corpus_id, path, content, {_fenced()} as x from ({select(q.RESPONSES)})", **level_ctes("docs", "aggressive"))


def _unwrap() -> str:
    """By line numbers: the last origin header before the first end marker."""
    ls = lines("text")
    end = f"list_position({t.each(ls, 'starts_with(x, ' + lit('# END SEMANTIC COMPRESSION') + ')')}, true)"
    head = f"list_slice({ls}, 1, {end} - 1)"
    start = f"list_position(list_reverse({t.each(head, 'starts_with(x, ' + lit('# Original:') + ')')}), true)"
    inner = strip(joined(f"list_slice({ls}, {end} - {start} + 1, {end} - 1)"))
    return (f"select corpus_id, path, case when starts_with(text, '# SEMANTIC COMPRESSION') and {end} > 0 and {start} > 0 then sha256({inner}) end as inner_sha "
            f"from ({select(q.ENVELOPES)})")


def _scripts(source: str) -> dict[str, str]:
    marks = " ".join(f"when starts_with(bare, {lit(m)}) then {lit(n)}" for n, m in fv.DIRECTIVES.items())
    head = "d is not null and coalesce(pos < body_start, true)"
    value = strip("substr(bare, position(':' in bare) + 1)")

    def last(name):
        return f"arg_max({value}, pos) filter (where {head} and d = '{name}') as {name}"

    return {
        "sl": f"select script_id, unnest(ls) as line, unnest(range(len(ls))) as pos from (select script_id, {splitlines('script')} as ls from ({source}))",
        "sd": f"select *, {strip('line')} as bare, case {marks.replace('bare', strip('line'))} end as d from sl",
        "sb": "select *, sum(case when d = 'file' then 1 else 0 end) over (partition by script_id order by pos) as block from sd",
        "sx": "select *, min(case when d = 'replace_with' then pos end) over (partition by script_id, block) as body_start from sb",
        "sg": f"select script_id, block, {last('file')}, {last('section')}, {last('find_method')}, {last('until_exclude')}, "
              f"case when max(body_start) is not null then coalesce(string_agg(line, {NL} order by pos) filter (where pos > body_start), '') end as replace_with, "
              f"count(*) filter (where {head}) as heads, count(body_start) as bodies from sx group by script_id, block",
        "instructions": "select script_id, row_number() over (partition by script_id order by block) as seq, file, section, find_method, until_exclude, replace_with "
                        "from sg where heads > 0 or bodies > 0",
    }


def _entries() -> dict[str, str]:
    return {"prose": PROSE, **level_ctes("prose", "light"),
            "entries": "select corpus_id as archive_id, path, reduced as content, original_size as original_size_bytes, reduced_size as compressed_size_bytes, "
                       "tokens as estimated_tokens, method as compression_method, ratio as compression_ratio from shown"}


_TOTALS = ("count(*) as total_files, cast(sum(original_size_bytes) as bigint) as total_original_size_bytes, "
           "cast(sum(compressed_size_bytes) as bigint) as total_compressed_size_bytes, cast(sum(estimated_tokens) as bigint) as total_estimated_tokens")


def _plan() -> dict[str, str]:
    safe = normalise("regexp_replace(path, '^/+', '')")
    return {"messy": select(q.MESSY), "planned": f"select *, {safe} as target from messy",
            "plan": "select corpus_id as archive_id, path, content, case when path = '' then 'skip_empty' when not regexp_matches(path, 'e') then 'skip_pattern' "
                    "when target = '.' or target = '..' or starts_with(target, '../') then 'skip_unsafe' else 'write' end as action, target from planned"}


def _requested() -> str:
    known = f"select {DOCS['corpus_id']} as corpus_id, {DOCS['path']} as path from documents join (select distinct doc_id from labels) using (doc_id)"
    return f"{known} union all select corpus_id, path || '.gone' from ({known})"


def _cache() -> dict[str, str]:
    known = f"select {', '.join(f'{e} as {n}' for n, e in DOCS.items())} from documents where source in ('src1', 'src2', 'src3')"
    return {"known": known, **level_ctes("known", "light"),
            "cache": "select distinct sha256(content) as content_sha256, file_type, 'light' as level, '' as model, reduced_sha, method, reduced_size, tokens from shown",
            "keyed": f"select corpus_id, path, sha256(content) as content_sha256, {t.file_type('path')} as file_type, 'light' as level, '' as model from docs"}


_LOOKED = ("select k.*, c.method || ' (cached)' as method, c.reduced_sha, c.method is not null as cached from keyed k "
           "left join cache c using (content_sha256, file_type, level, model)")


def compare_ctes() -> dict[str, str]:
    def norm(x):
        return strip(joined(where(t.each(splitlines(x), strip("x")), "x <> ''")))

    ctes = {}
    for v in ("old", "new"):
        ctes.update(ss.statement_ctes(f"mods_{v}", v))
        ctes.update(ss.definition_ctes(f"mods_{v}", v))
        ctes[f"{v}_by"] = (f"select corpus_id, path, name, arg_max(source, (indent, start_line)) as source, arg_max(signature, (indent, start_line)) as signature, "
                           f"arg_min(end_line, (indent, start_line)) as end_line from {v}_defs group by corpus_id, path, name")
    ctes["pairs"] = ("select coalesce(o.corpus_id, n.corpus_id) as corpus_id, coalesce(o.path, n.path) as path, coalesce(o.name, n.name) as method_name, "
                     "o.source as old_source, n.source as new_source, o.signature as old_signature, n.signature as new_signature, o.end_line as old_end "
                     "from old_by o full outer join new_by n on o.corpus_id = n.corpus_id and o.path = n.path and o.name = n.name")
    ctes["changes"] = (f"select * from (select *, case when old_source is null then 'added' when new_source is null then 'removed' "
                       f"when {norm('old_source')} <> {norm('new_source')} then 'modified' end as change_type from pairs) where change_type is not null")
    return ctes


def _heads(source: str) -> str:
    return (f"select * from (select corpus_id, path, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as line from "
            f"(select corpus_id, path, {splitlines('content')} as ls from {source})) where {starts(t.lstrip('line'), fv.DEFINITION_STARTS)}")


def edit_ctes() -> dict[str, str]:
    following = (f"select c.corpus_id, c.path, c.method_name, arg_min({strip('h.line')}, h.line_no) as following from changes c join heads h "
                 "on h.corpus_id = c.corpus_id and h.path = c.path and h.line_no > c.old_end group by all")
    return {**compare_ctes(), "heads": _heads("mods_old"), "following": following,
            "edits": f"select concat_ws(':', corpus_id, path) as script_id, row_number() over (partition by corpus_id, path order by change_type, method_name) as seq, "
                     f"{t.basename('path')} as file, case when change_type = 'added' then '' else old_signature end as find_method, "
                     f"case when change_type = 'added' then '' else coalesce(following, '') end as until_exclude, "
                     f"case when change_type = 'removed' then '' else new_source end as replace_with from changes left join following using (corpus_id, path, method_name)"}


_BODY = f"('# new' || {NL} || path || {NL} || {NL})"


def _file_text(ls: str) -> str:
    return f"case when len({ls}) = 0 then '' else array_to_string({ls}, {NL}) || {NL} end"


def _preamble() -> str:
    hit = f"case when until <> '' then list_position({t.each('ls', 'contains(' + strip('x') + ', until)')}, true) else list_position({t.each('ls', starts(t.lstrip('x'), fv.DEFINITION_STARTS))}, true) end"
    after = f"list_concat({splitlines(_BODY)}, case when hit > 0 then list_slice(ls, hit, len(ls)) else cast([] as varchar[]) end)"
    return statement(f"select corpus_id, path, until, sha256({_file_text('after')}) as after_sha from (select *, {after} as after from "
                     f"(select *, {hit} as hit from (select *, {splitlines('content')} as ls, unnest(['class Bin', '', 'absent']) as until from mods_old)))", "mods_old")


def _append() -> str:
    gap = f"case when len(ls) > 0 and {strip('ls[len(ls)]')} <> '' then [''] else cast([] as varchar[]) end"
    after = f"case when {strip('body')} <> '' then list_concat(list_concat(ls, {gap}), {splitlines('body')}) else ls end"
    return statement(f"select corpus_id, path, until, sha256({_file_text('after')}) as after_sha from (select *, {after} as after from "
                     f"(select *, {splitlines('content')} as ls, unnest([0, 1]) as until, unnest([{_BODY}, ' ' || {NL}]) as body from mods_old))", "mods_old")


def _replace() -> str:
    """By line numbers: decorators are the run of '@', blank and '#' lines above, from its first '@' line on."""
    starts_def = starts(t.lstrip("x"), fv.DEFINITION_STARTS)
    ctes = {
        **ss.statement_ctes("mods_old", "st"), **ss.definition_ctes("mods_old", "st"),
        "asked": f"select f.corpus_id, f.path, {splitlines('f.content')} as ls, 'def ' || d.name || '(' as find, unnest(['', 'def top_', '# brand']) as until "
                 "from st_defs d join mods_old f using (corpus_id, path)",
        "found": f"select *, list_position({t.each('ls', 'contains(' + strip('x') + ', find)')}, true) as hit from asked",
        "marked": "select *, array_to_string(list_transform(list_reverse(list_slice(ls, 1, hit - 1)), lambda x: case when starts_with("
                  f"{strip('x')}, '@') then 'D' when {strip('x')} = '' or starts_with({strip('x')}, '#') then 'S' else 'X' end), '') as marks from found",
        "begun": "select *, hit - length(regexp_extract(marks, '^[DS]*D')) as beg from marked",
        "rested": "select *, list_slice(ls, beg + 1, len(ls)) as rest, length(ls[beg]) - length(ltrim(ls[beg])) as lim from begun",
        "ended": f"select *, case when until <> '' then list_position({t.each('rest', 'contains(' + strip('x') + ', until)')}, true) "
                 f"else list_position({t.each('rest', starts_def + ' and length(x) - length(' + t.lstrip('x') + ') <= lim')}, true) end as stop from rested",
        "after": f"select *, list_concat(list_concat(list_slice(ls, 1, beg - 1), case when until = '# brand' then cast([] as varchar[]) else {splitlines(_BODY)} end), "
                 "case when stop > 0 then list_slice(rest, stop, len(rest)) else cast([] as varchar[]) end) as done from ended",
    }
    return statement(f"select corpus_id, path, find, until, sha256({_file_text('done')}) as after_sha from after", "mods_old", **ctes)


def _importance() -> str:
    name = f"lower({t.basename('path')})"
    return (f"case when {t.has(name, r'^(?:readme|main)(?:\.|\z)')} then 3 when {t.has(name, r'^test_|_test\.|\.test\.|\.spec\.')} or "
            f"{t.has('path', '(?:^|/)tests?/')} then 0 when {t.has(name, r'^(?:utils?|helpers?)(?:\.|\z)')} then 1 else 2 end")


_RANK = "partition by corpus_id order by importance_score desc, path"


def _nested(ctes: dict[str, str], body: str) -> str:
    """A parenthesised statement of its own, so that CTE names may repeat elsewhere."""
    return f"(with {', '.join(f'{n} as ({s})' for n, s in ctes.items())} {body})"


def _budget_levels() -> str:
    levels = ("light", "medium", "aggressive")
    each = [_nested(level_ctes("prose", n), f"select corpus_id, path, tokens as {n} from shown") for n in levels]
    ctes = {"prose": PROSE,
            "tk": f"select *, {_importance()} as importance_score from {each[0]} join {each[1]} using (corpus_id, path) join {each[2]} using (corpus_id, path)",
            "chosen": f"select corpus_id, case when sum(light) <= {q.BUDGET} then 'light' when sum(medium) <= {q.BUDGET} then 'medium' else 'aggressive' end as level from tk group by corpus_id",
            "leveled": "select *, case level when 'light' then light when 'medium' then medium else aggressive end as tokens from tk join chosen using (corpus_id)",
            "summed": f"select *, row_number() over ({_RANK}) as priority_rank, cast(sum(tokens) over ({_RANK}) as bigint) as running_tokens from leveled"}
    return statement(f"select corpus_id, path, importance_score, priority_rank, level, tokens, running_tokens, running_tokens <= {q.BUDGET} as kept from summed",
                     "docs", "sites", **ctes)


def _applied_ctes() -> dict[str, str]:
    """Edits one after the other: a recursive walk over each script's instructions."""
    opens = starts(t.lstrip("x"), fv.DEFINITION_STARTS)
    empty = "cast([] as varchar[])"
    body = f"case when {strip('replace_with')} <> '' then {splitlines('replace_with')} else {empty} end"
    find, until = strip("find_method"), strip("until_exclude")
    gap = f"case when len(ls) > 0 and {strip('ls[len(ls)]')} <> '' then [''] else {empty} end"
    step = "select s.corpus_id, s.path, s.k + 1 as k, s.ls, s.applied, e.find_method, e.until_exclude, e.replace_with from walk s join edits e on e.script_id = concat_ws(':', s.corpus_id, s.path) and e.seq = s.k + 1"
    found = f"select *, list_position({t.each('ls', 'contains(' + strip('x') + ', ' + find + ')')}, true) as hit from ({step})"
    marks = f"array_to_string(list_transform(list_reverse(list_slice(ls, 1, hit - 1)), lambda x: case when starts_with({strip('x')}, '@') then 'D' when {strip('x')} = '' or starts_with({strip('x')}, '#') then 'S' else 'X' end), '')"
    begun = f"select *, hit - length(regexp_extract({marks}, '^[DS]*D')) as beg from ({found})"
    rested = f"select *, list_slice(ls, beg + 1, len(ls)) as rest, length(ls[beg]) - length({t.lstrip('ls[beg]')}) as lim from ({begun})"
    stop = (f"select *, case when {until} <> '' then list_position({t.each('rest', 'contains(' + strip('x') + ', ' + until + ')')}, true) else "
            f"list_position({t.each('rest', opens + ' and length(x) - length(' + t.lstrip('x') + ') <= lim')}, true) end as stop from ({rested})")
    after = (f"case when {find} = '' then case when {strip('replace_with')} <> '' then list_concat(list_concat(ls, {gap}), {body}) else ls end "
             f"when hit > 0 then list_concat(list_concat(list_slice(ls, 1, beg - 1), {body}), case when stop > 0 then list_slice(rest, stop, len(rest)) else {empty} end) else ls end")
    return {**edit_ctes(),
            "walk": f"select corpus_id, path, cast(0 as bigint) as k, {splitlines('content')} as ls, 0 as applied from mods_old union all "
                    f"select corpus_id, path, k, {after}, applied + case when {find} = '' or hit > 0 then 1 else 0 end from ({stop})",
            "walked": "select corpus_id, path, k as n_instructions, ls, applied from (select *, row_number() over (partition by corpus_id, path order by k desc) as r from walk) where r = 1 and k > 0"}


def _audit_documents() -> str:
    """By JSON functions over the document text; arrays of entries are unnested."""
    keys = " union all ".join(f"select {i} as k, 'missing {name}' as violation, '{name}' as name" for i, name in enumerate(fv.REQUIRED_ENTRY_KEYS))
    ctes = {
        "d": select(q.DOCUMENTS), "v": "select *, case when json_valid(document) then json_type(document) end as ty from d",
        "o": f"select *, ty = 'OBJECT' and json_exists(document, '$.metadata') and json_exists(document, '$.files') as ok from v",
        "whole": f"""select archive_id, 0 as entry, 0 as k, 'bad json' as violation from o where ty is null
            union all select archive_id, 0, 0, 'missing metadata or files' from o where ty is not null and not ok
            union all select archive_id, 0, 0, 'missing format version' from o where ok and not json_exists(document, '$.metadata.{fv.VERSION_KEY}')
            union all select archive_id, 0, 1, 'files not a list' from o where ok and json_type(document, '$.files') <> 'ARRAY'""",
        "e": "select archive_id, unnest(json_extract(document, '$.files[*]')) as item, unnest(range(1, len(json_extract(document, '$.files[*]')) + 1)) as entry "
             "from o where ok and json_type(document, '$.files') = 'ARRAY'",
        "part": f"""select archive_id, entry, 0 as k, 'entry not an object' as violation from e where json_type(item) <> 'OBJECT'
            union all select archive_id, entry, k, violation from e, ({keys}) where json_type(item) = 'OBJECT' and not json_exists(item, '$.' || name)""",
        "every": "select * from whole union all select * from part",
    }
    return statement("select archive_id, entry, violation, row_number() over (partition by archive_id order by entry, k) = 1 as is_first from every", **ctes)


def _wildcard() -> str:
    """The wildcard of the query, written out by hand as a regex."""
    regex = r"^.*/src1/.*_[0-9].*\.[jp].*\z"
    return statement(f"select {K} from files where {t.has('path', '(?s)' + regex)} or {t.has(t.basename('path'), '(?s)' + regex)}", "files")


_CALLS = select(q.CALLS, "events")
_PRESENT = "partition by caller order by ts range between interval 6 hours preceding and current row"

ORACLES = {
    "scan_binary": "select doc_id, sha256(t) as text_sha, length(t) as n_decoded from (select doc_id, "
                   "concat(text, case when doc_id % 2 = 0 then chr(65533) else '' end) as t from documents)",
    "scan_corpus": statement("select corpus_id || '/' || path as path, strlen(content) as size_bytes, sha256(content) as content_sha from docs "
                             f"where {t.among(t.suffix('path'), ['.py', '.md', '.txt'])}", "docs"),
    "archive_roundtrip": statement("select archive_id, path, original_size_bytes, compressed_size_bytes, estimated_tokens, compression_method, "
                                   "compression_ratio, sha256(content) as content_sha from entries", "docs", "sites", **_entries()),
    "archive_write": statement("select archive_id, cast(0 as bigint) as volume, cast(count(*) as int) as n_entries, " + _TOTALS +
                               ", min(path) as first_path from entries group by archive_id", "docs", "sites", **_entries()),
    "extract_plan": statement("select archive_id, path, case when action = 'write' then target end as safe_path, action, sha256(content) as content_sha from plan", **_plan()),
    "parse_edit_scripts": statement("select script_id, seq, file, section, find_method, until_exclude, sha256(replace_with) as replace_sha from instructions",
                                    **_scripts(select(q.SCRIPTS))),
    "render_edit_scripts": statement(
        f"select script_id, sha256(s) as script_sha, length(s) as n_chars from (select script_id, string_agg('FILE: ' || file || {NL} || 'FIND_METHOD: ' || find_method || {NL} "
        f"|| 'UNTIL_EXCLUDE: ' || until_exclude || {NL} || 'REPLACE_WITH:' || {NL} || replace_with || {NL}, '' order by seq) as s from edits group by script_id)",
        "mods_old", "mods_new", **edit_ctes()),
    "cache_upsert": statement(
        "select c.content_sha256, c.file_type, c.level, c.model, c.method, c.reduced_size, c.tokens from cache c anti join fresh f using (content_sha256, file_type) "
        "union all select content_sha256, file_type, 'light', '', 'forced', 0, 0 from fresh", "docs", **_cache(),
        fresh=f"select distinct sha256(text) as content_sha256, {t.file_type(DOCS['path'])} as file_type from documents where source in ('src3', 'src4')"),
    "filter_extension": statement(f"select {K} from files where {t.among(t.suffix('path'), ['.py', '.js', '.html'])}", "files"),
    "filter_path_regex": statement(f"select {K} from files where {t.has('path', q.REGEX)}", "files"),
    "filter_wildcard": _wildcard(),
    "available_paths": statement("select r.path, r.corpus_id from requested r semi join docs using (corpus_id, path)", "docs", requested=_requested()),
    "missing_paths": statement("select r.path, r.corpus_id from requested r anti join docs using (corpus_id, path)", "docs", requested=_requested()),
    "detect_file_type": statement(f"select {K}, {t.file_type('path')} as file_type from files", "files"),
    "normalise_paths": f"select corpus_id, path, {normalise('path')} as normal from ({select(q.MESSY)})",
    "list_archive": statement(
        f"select archive_id, path, total_original_size_bytes, total_compressed_size_bytes, total_estimated_tokens, matched, total from entries join "
        f"(select archive_id, {_TOTALS}, count(*) filter (where {t.has('path', q.REGEX)}) as matched, count(*) as total from entries group by archive_id) "
        f"using (archive_id) where {t.has('path', q.REGEX)}", "docs", "sites", **_entries()),
    "list_archive_detailed": statement(
        f"select archive_id, path, original_size_bytes, compressed_size_bytes, round(compression_ratio, 1) as ratio, estimated_tokens, compression_method, len(ls) > 2 as more, "
        f"sha256({joined('list_transform(list_slice(ls, 1, 2), lambda x: left(x, 80) || case when length(x) > 80 then ' + lit('...') + ' else ' + lit('') + ' end)')}) as preview_sha "
        f"from (select *, {splitlines('content')} as ls from entries) where {t.has('path', q.REGEX)}", "docs", "sites", **_entries()),
    "compress_none": _level("none", "prose"), "compress_light": _level("light", "files"), "compress_medium": _level("medium", "files"),
    "signatures_js": _signature("js"), "signatures_java": _signature("java"), "signatures_cfamily": _signature("cpp", "h"),
    "compress_regex_generic": statement(f"select {K}, file_type, sha256({t.regex_medium('content', 'file_type')}) as reduced_sha from typed where file_type <> 'python'",
                                        "files", **typed("files")),
    "compress_aggressive": _level("aggressive", "files"), "compress_smart": _level("smart", "files"),
    "compress_summary": _summary(),
    "prefix_preview": statement(f"select {K}, sha256(left(content, 2000) || {NL} || '# ... Signature preview (stub from outlining.py)') as preview_sha from files", "files"),
    "prompt_table": statement(
        f"select {K}, sha256(content) as content_sha256, 'm1' as model, 2000 as max_tokens, 0.1e0 as temperature, "
        "390 + length(path) + length(file_type) + length(cast(strlen(cut) as varchar)) + length(cut) as n_chars, sha256(cut) as body_sha from "
        f"(select *, case when length(content) > 2000 then left(content, 2000) || {NL} || '... (content truncated for brevity) ...' else content end as cut from typed "
        f"where not {t.blank('content')})", "docs", "sites", prose=PROSE, **typed("prose")),
    "ingest_responses": _ingest(), "unwrap_envelope": _unwrap(),
    "estimate_tokens": statement(f"select {K}, file_type, {t.tokens('clean', 'content', 'file_type')} as tokens from cl", "files", **typed("files"),
                                 cl=f"select *, {t.cleaned('content', 'file_type')} as clean from typed"),
    "clean_for_tokens": statement(f"select {K}, sha256(clean) as clean_sha, length(clean) as n_chars from cl", "files", **typed("files"),
                                  cl=f"select *, {t.cleaned('content', 'file_type')} as clean from typed"),
    "estimate_tokens_crude": statement(f"select {K}, length(content) // 3 as tokens from files", "files"),
    "line_table": statement(f"select {K}, line_no, length(line) - length({t.lstrip('line')}) as indent, sha256(line) as line_sha from "
                            f"(select {K}, unnest({lines('content')}) as line, unnest(range(1, len({lines('content')}) + 1)) as line_no from files)", "files"),
    "definition_index": _structure("select corpus_id, path, name, is_async, start_line, end_line, indent, signature, sha256(source) as source_sha from st_defs",
                                   extra=ss.definition_ctes("mods_new", "st")),
    "import_index": _structure(f"select {K}, start_line as line_no, indent, unnest(range(len(v))) as ordinal, unnest(v) as statement from "
                               f"(select *, {ss.imported()} as v from st where kind in ('import', 'from'))"),
    "class_index": _structure(
        f"select {K}, owner_sig as class, start_line as line_no, unnest(range(len(v))) as ordinal, member, unnest(v) as value from ("
        f"select *, 'class' as member, [sig] as v from st_own where kind = 'class' and indent = 0 union all "
        f"select *, 'method', [sig] from st_own where class_item and kind = 'def' union all "
        f"select *, 'variable', {ss.assigned(False)} from st_own where class_item and kind = 'other')", extra=ss.owner_ctes("st")),
    "toplevel_symbols": _structure(
        f"select {K}, 'function' as symbol, sig as value, start_line as line_no from st where indent = 0 and stmt > 0 and kind = 'def' union all "
        f"select {K}, 'variable', value, min(start_line) from (select *, unnest({ss.assigned(True)}) as value from st where indent = 0 and stmt > 0 and kind = 'other') group by corpus_id, path, value"),
    "structure_skeleton": _structure(f"select {K}, sha256(skeleton) as skeleton_sha, length(skeleton) as n_chars from st_skel",
                                     extra={**ss.owner_ctes("st"), **ss.skeleton_ctes("st")}),
    # What is broken is known from the number of the module, not from its text.
    "python_validity": statement(f"select {K}, breakage, breakage = 0 as parses from mods_old, "
                                 f"(select unnest(range({len(q.BREAKAGES) + 1})) as breakage)", "mods_old"),
    "outline": _structure(
        f"select {K}, sha256(o) as outline_sha, length(o) as n_chars from (select {K}, string_agg(case when not imp and coalesce(was, false) then {NL} else '' end || entry, {NL} order by stmt) "
        f"|| {NL} || '# ... (Structure extracted via AST - outlining.py)' as o from (select *, lag(imp) over (partition by corpus_id, path order by stmt) as was from "
        f"(select *, kind in ('import', 'from') as imp, case when kind in ('import', 'from') then {strip('text')} else {strip('first')} || ' ...' end as entry "
        f"from (select *, split_part(text, {NL}, 1) as first from st_all where kind in ('import', 'from', 'def', 'async def', 'class')))) group by corpus_id, path)"),
    "compare_versions": statement(f"select {K}, change_type, method_name, old_signature, new_signature, sha256(old_source) as old_sha, sha256(new_source) as new_sha from changes",
                                  "mods_old", "mods_new", **compare_ctes()),
    "next_definition": statement(
        f"select c.corpus_id, c.path, c.end_line, coalesce(arg_min({strip('h.line')}, h.line_no), '') as following from (select distinct corpus_id, path, end_line from st_defs) c "
        "left join heads h on h.corpus_id = c.corpus_id and h.path = c.path and h.line_no > c.end_line group by all",
        "mods_old", **ss.statement_ctes("mods_old", "st"), **ss.definition_ctes("mods_old", "st"), heads=_heads("mods_old")),
    "generate_edits": statement("select script_id, seq, file, find_method, until_exclude, sha256(replace_with) as replace_sha from edits", "mods_old", "mods_new", **edit_ctes()),
    "apply_edits": statement(f"select concat_ws(':', corpus_id, path) as script_id, path as file, sha256({_file_text('ls')}) as content_sha, n_instructions, applied from walked",
                             "mods_old", "mods_new", **_applied_ctes()).replace("with ", "with recursive ", 1),
    "apply_report": statement("select concat_ws(':', corpus_id, path) as script_id, n_instructions, applied, applied > 0 as success from walked",
                              "mods_old", "mods_new", **_applied_ctes()).replace("with ", "with recursive ", 1),
    "apply_script_chain": statement(
        f"select corpus_id, path as file, 3 as n_scripts, 4 as n_instructions, 3 as applied, sha256({_file_text('after')}) as content_sha from "
        f"(select *, list_concat(list_concat(list_append(ls[1:top - 1], '# went'), ls[poll:]), case when {strip('ls[len(ls)]')} <> '' then ['', '# done'] else ['# done'] end) as after from "
        f"(select *, list_position({t.each('ls', 'contains(x, ' + lit('def top_') + ')')}, true) as top, list_position({t.each('ls', 'contains(x, ' + lit('async def poll_') + ')')}, true) as poll "
        f"from (select *, {splitlines('content')} as ls from mods_old)))", "mods_old"),
    "script_chain_report": statement(
        "select s.script_id, corpus_id, path as file, s.seq, s.applied, s.conflict from mods_old, (values ('s2', 1, true, false), ('s1', 1, false, true), "
        "('s1', 2, true, false), ('s0', 1, true, false)) s(script_id, seq, applied, conflict)", "mods_old"),
    "compress_smart_unavailable": _unavailable("smart"), "compress_semantic_unavailable": _unavailable("semantic"),
    "apply_preamble": _preamble(), "apply_append": _append(), "apply_replace": _replace(),
    "archive_totals": statement(f"select archive_id, {_TOTALS} from entries group by archive_id", "docs", "sites", **_entries()),
    "corpus_stats": statement(
        "select r.corpus_id, count(*) as total_files, cast(coalesce(sum(strlen(content)), 0) as bigint) as total_size_bytes, coalesce(max(strlen(content)), 0) as largest_file_size, "
        "coalesce(min(strlen(content)), 0) as smallest_file_size from requested r left join docs d using (corpus_id, path) group by r.corpus_id", "docs", requested=_requested()),
    "extension_histogram": statement(f"select corpus_id, {t.suffix('path')} as extension, count(*) as n_files from files group by all", "files"),
    "cache_stats": statement("select count(*) filter (where cached) as hits, count(*) filter (where not cached) as misses, count(*) as total_lookups, "
                             f"count(*) filter (where cached) / count(*) * 100 as hit_rate_percent from ({_LOOKED})", "docs", **_cache()),
    "call_log_stats": "select caller, count(*) as total_requests, count(*) filter (where status_code >= 400) as total_errors, count(*) filter (where waited_s > 0) as blocked_requests, "
                      "round(count(*) filter (where status_code >= 400) / greatest(1, count(*)) * 100, 2) as error_rate_percent, "
                      f"round(coalesce(avg(duration_s) filter (where status_code < 400), 0), 2) as avg_success_seconds from ({_CALLS}) group by caller",
    "errors_by_class": "select caller, case when status_code = 429 then 'rate_limit' when status_code in (500, 502, 503, 504) then 'server_error' else 'other' end as error_class, "
                       f"count(*) as n_errors from ({_CALLS}) where status_code >= 400 group by all",
    "method_summary": statement("select method, count(*) as n_files, sum(length(content) / 64e0) as total_wait, avg(length(content) / 64e0) as avg_wait from shown group by method",
                                "docs", **level_ctes("docs", "smart")),
    "audit_counts": statement("select archive_id, count(*) filter (where regexp_matches(path, 'e')) as matched, count(*) as total, count(*) filter (where action = 'write') as extracted "
                              "from plan group by archive_id", **_plan()),
    "cache_lookup": statement(f"select corpus_id, path, content_sha256, file_type, cached, method, reduced_sha from ({_LOOKED})", "docs", **_cache()),
    "cache_misses": statement("select distinct content_sha256, file_type, level, model from keyed k anti join cache c using (content_sha256, file_type, level, model)", "docs", **_cache()),
    "dedupe_compute": statement("select corpus_id, path, sha256(content) as content_sha256, file_type, method, reduced_sha, tokens from shown", "docs", "sites", prose=PROSE,
                                **level_ctes("prose", "medium")),
    "union_targets": statement(f"select {K} from docs where {t.suffix('path')} = '.py' or regexp_matches(path, 'src1') or starts_with({t.basename('path')}, 'main.')", "docs"),
    "priority_rank": statement(f"select {K}, importance_score, row_number() over ({_RANK}) as priority_rank from (select {K}, {_importance()} as importance_score from files)", "files"),
    "budget_fit": statement(
        f"select * from (select {K}, importance_score, tokens, row_number() over ({_RANK}) as priority_rank, cast(sum(tokens) over ({_RANK}) as bigint) as running_tokens from "
        f"(select {K}, {_importance()} as importance_score, {t.tokens('clean', 'content', 'file_type')} as tokens from cl)) where running_tokens <= {q.BUDGET}", "files",
        **typed("files"), cl=f"select *, {t.cleaned('content', 'file_type')} as clean from typed"),
    "budget_level": _budget_levels(),
    "sliding_requests": f"select caller, call_id, n as recent_requests, n < 2 as allowed from (select caller, call_id, count(*) over ({_PRESENT}) - 1 - "
                        "(count(*) over (partition by caller, ts) - row_number() over (partition by caller, ts order by call_id)) as n "
                        f"from ({_CALLS}))",
    "error_streak": "select caller, call_id, is_error, sum(is_error) over (partition by caller, island order by ts, call_id) as consecutive_errors from "
                    "(select *, sum(1 - is_error) over (partition by caller order by ts, call_id) as island from "
                    f"(select *, cast(status_code >= 400 as bigint) as is_error from ({_CALLS})))",
    "recent_errors": "select c.caller, count(*) filter (where e.ts is not null and c.last_ts - e.ts < interval 5 days) as recent_errors, count(e.ts) as kept_errors from "
                     f"(select caller, max(ts) as last_ts from ({_CALLS}) group by caller) c left join (select * from ({_CALLS}) where status_code >= 400 "
                     "qualify row_number() over (partition by caller order by ts desc, call_id desc) <= 10) e using (caller) group by c.caller",
    "audit_archives": _audit_documents(),
    "audit_edit_scripts": statement(
        "select s.script_id, coalesce(n, 0) as n_instructions, coalesce(bad, 0) as without_file, coalesce(odd, 0) as unknown_sections, case when n is null then s.script = '' else bad = 0 end as valid "
        f"from ({select(q.SCRIPTS)}) s left join (select script_id, count(*) as n, count(*) filter (where coalesce(file, '') = '') as bad, "
        "count(*) filter (where section not in ('METHOD', 'GLOBAL_PREAMBLE', '')) as odd from instructions group by script_id) i using (script_id)", **_scripts(select(q.SCRIPTS))),
}

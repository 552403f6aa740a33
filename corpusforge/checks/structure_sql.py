"""DuckDB text of the Python structure tables."""

from corpusforge.checks.sqltext import (
    NL, each, joined, lines, lit, lstrip, pick, pick_all, rstrip, splitlines, starts, strip, sub, where, among, has, WS as WS_ALL,
)
from corpusforge.fixed_values import DEFINITION_STARTS
from corpusforge.functions.text import NAME

LEXER = (r'(?s)"""(?:[^\\]|\\.)*?"""' + r"|'''(?:[^\\]|\\.)*?'''" + r'|"(?:[^"\\\n]|\\.)*"' + r"|'(?:[^'\\\n]|\\.)*'"
         + r"""|#[^\n]*|[^"'#]+|["']""")


_BLOCKS = ["def", "class", "if", "elif", "else", "for", "while", "with", "try", "except", "finally"]
# Words after which a value may begin, and words that may follow a value.
_BEFORE = (_BLOCKS + "and as assert async await case del from global import in is lambda match nonlocal not or pass raise return "
           "type yield".split())
_BEHIND = "and as async else for from if import in is not or".split()
_OPEN, _CLOSE = "c in ('(', '[', '{')", "c in (')', ']', '}')"
_KEY = "corpus_id, path, stmt"


def statement_ctes(source: str, name: str) -> dict[str, str]:
    """CTEs up to ``{name}``: statements of the files in ``source`` that parse, and ``{name}_all``: all statements."""
    quoted = sub(sub("x", "[^\n]", "chr(34)"), "\n", "chr(10) || chr(1)")
    mask = (f"case when starts_with(x, '#') then '' when x = chr(34) or x = chr(39) then chr(2) "
            f"when starts_with(x, chr(34)) or starts_with(x, chr(39)) then {quoted} else x end")
    text = f"replace(content, chr(13) || chr(10), {NL})"
    code = joined(each("toks", "case when starts_with(x, '#') then '' else x end"), "''")
    flat = "replace(m, chr(9), '        ')"
    order = "partition by corpus_id, path order by line_no"
    before = "rows between unbounded preceding and 1 preceding"
    return {
        f"{name}_tok": f"select corpus_id, path, {pick_all(text, LEXER, 0)} as toks from {source}",
        f"{name}_split": f"select corpus_id, path, {lines(code)} as codes, {lines(joined(each('toks', mask), chr(39) * 2))} as masks from {name}_tok",
        f"{name}_raw": f"select corpus_id, path, unnest(range(1, len(codes) + 1)) as line_no, unnest(codes) as code, unnest(masks) as mk from {name}_split",
        f"{name}_ln0": f"select *, starts_with(mk, chr(1)) as in_string, contains(mk, chr(2)) as stray, replace(mk, chr(1), '') as m from {name}_raw",
        f"{name}_ln1": f"select *, length(translate(m, ')]}}', '')) - length(translate(m, '([{{', '')) as net, {lstrip('m')} = '' as blank, length({flat}) - length(ltrim({flat}, ' ')) as indent from {name}_ln0",
        f"{name}_ln2": f"select *, not blank and not in_string and coalesce(sum(net) over ({order} {before}), 0) <= 0 and not coalesce(lag(m) over ({order}) like '%' || chr(92), false) as starts from {name}_ln1",
        f"{name}_ln": f"select *, sum(cast(starts as int)) over ({order}) as stmt from {name}_ln2",
        f"{name}_st": f"select corpus_id, path, stmt, min(line_no) as start_line, max(line_no) filter (where not blank) as end_line, max(indent) filter (where starts) as indent, string_agg({sub('code', chr(92) * 2 + chr(92) + 'z', lit(' '))}, {NL} order by line_no) as text, string_agg({sub('m', chr(92) * 2 + chr(92) + 'z', lit(' '))}, {NL} order by line_no) as masked, arg_max(code, line_no) filter (where not blank) as last_code, sum(net) as net, bool_or(stray) as stray from {name}_ln group by corpus_id, path, stmt",
        **_parts(name),
        f"{name}_kinds": f"""select *, case when {has('masked', rf'^\s*def\s+{NAME}')} then 'def'
            when {has('masked', rf'^\s*async\s+def\s+{NAME}')} then 'async def' when {has('masked', rf'^\s*class\s+{NAME}')} then 'class'
            when {has('masked', r'^\s*import\s')} then 'import' when {has('masked', r'(?s)^\s*from[\s.].*[\s.]import[\s(*]')} then 'from'
            when {has('masked', r'^\s*@')} then 'decorator' else 'other' end as kind, stray or net <> 0 or {_flawed()} as flawed
            from {name}_part""",
        f"{name}_lines": f"""select *, lag(indent) over w as was, coalesce(lag(opens) over w, false) as awaited, lead(stmt) over w is null as final
            from {name}_kinds where sub = 0 and stmt > 0 window w as (partition by corpus_id, path order by stmt)""",
        f"{name}_level": f"""select a.corpus_id, a.path, a.stmt, arg_max(b.indent, b.stmt) as level from {name}_lines a join {name}_lines b
            on a.corpus_id = b.corpus_id and a.path = b.path and b.stmt < a.stmt and b.indent <= a.indent group by all""",
        f"{name}_blocks": f"""select corpus_id, path, bool_or(final and opens or case when was is null then indent <> 0
            when awaited then indent <= was else level is null or indent <> level end) as unnested
            from {name}_lines left join {name}_level using (corpus_id, path, stmt) group by all""",
        **_headers(name),
        f"{name}_all": f"""select k.*, sig, sig_noted, not (bool_or(flawed) over (partition by k.corpus_id, k.path) or coalesce(unnested, false)) as parses
            from {name}_kinds k left join {name}_blocks b on b.corpus_id = k.corpus_id and b.path = k.path
            left join {name}_sig g on g.corpus_id = k.corpus_id and g.path = k.path and g.stmt = k.stmt""",
        name: f"select * from {name}_all where parses",
    }


def _characters(name: str, source: str, test: str) -> dict[str, str]:
    """``{name}``: every character of the statements with its bracket level; a bracket is on the level outside of it."""
    return {
        f"{name}0": f"select {_KEY}, unnest(range(1, length(masked) + 1)) as i, unnest(string_split(masked, '')) as c, unnest(string_split(text, '')) as t from {source} where {test}",
        name: f"""select *, sum(case when {_OPEN} then 1 when {_CLOSE} then -1 else 0 end) over (partition by {_KEY} order by i)
            - case when {_OPEN} then 1 else 0 end as level, c not in (' ', chr(9), chr(10)) as solid from {name}0""",
    }


def _parts(name: str) -> dict[str, str]:
    """``{name}_part``: logical lines cut into statements, numbered ``stmt``, with ``sub`` (place on the line) and ``opens``."""
    keyword = rf"^\s*(?:(?:async\s+)?(?:{'|'.join(_BLOCKS)})(?:[^\p{{L}}\p{{N}}_]|\z)|case\s)"
    several = f"(contains(masked, ';') or ({has('masked', keyword)} and not {rstrip('masked')} like '%:'))"
    return {
        **_characters(f"{name}_c", f"{name}_st", several),
        f"{name}_colon": f"select {_KEY}, min(i) as colon from {name}_c join {name}_st using ({_KEY}) where c = ':' and level = 0 and {has('masked', keyword)} group by all",
        f"{name}_inline": f"select {_KEY}, colon from {name}_c join {name}_colon using ({_KEY}) group by all having bool_or(solid and i > colon)",
        f"{name}_cut": f"""select c.*, coalesce(i > colon, false) as deeper, c = ';' and level = 0 and coalesce(i > colon, true) as mark,
            sum(cast(c = chr(10) as int)) over (partition by {_KEY} order by i) as down from {name}_c c left join {name}_inline using ({_KEY})""",
        f"{name}_cell": f"""select *, cast(deeper as int) + coalesce(sum(cast(mark as int)) over (partition by {_KEY} order by i rows between
            unbounded preceding and 1 preceding), 0) as k from {name}_cut""",
        f"{name}_bits": f"""select {_KEY}, k, bool_or(deeper) as deeper, string_agg(c, '' order by i) as masked, string_agg(t, '' order by i) as text,
            min(down) filter (where solid) as down0, max(down) filter (where solid) as down1, row_number() over (partition by {_KEY} order by k) - 1 as sub,
            count(*) over (partition by {_KEY}) as n from {name}_cell where not mark group by {_KEY}, k having bool_or(solid)""",
        f"{name}_part": f"""select corpus_id, path, stmt * 1000000 as stmt, start_line, end_line, indent, text, masked, last_code, net, stray, 0 as sub,
                {rstrip('masked')} like '%:' as opens from {name}_st where not {several}
            union all select corpus_id, path, s.stmt * 1000000 + sub, start_line + down0, case when n = 1 then end_line else start_line + down1 end,
                indent + cast(deeper as int), b.text, b.masked, last_code, net, stray, sub, n = 1 and {rstrip('b.masked')} like '%:'
            from {name}_st s join {name}_bits b using (corpus_id, path, stmt)""",
    }


def _flawed() -> str:
    """No grammar accepts the statement, by its neighbouring tokens and its end."""
    toks = pick_all("masked", r'[\p{L}_][\p{L}\p{N}_]*|[0-9][\p{L}\p{N}_.]*|"+|[ \t]+|[^\p{L}\p{N}_" \t]', 0)
    left, right = "toks[i - 1]", "toks[i + 1]"
    named, behind = (has(side, r"^[\p{L}_]") for side in (left, right))
    free = f"{named} and not {among(left, _BEFORE)} and coalesce(toks[i - 2], '') <> '.'"
    value = f"({free} or {has(left, '^[0-9]')} or {has(left, '^[' + chr(34) + ')}]|^]')})"
    prefixed = f"{has(right, '^[rRbBuUfFtT][rRbBuUfFtT]?$')} and starts_with(coalesce(toks[i + 2], ''), chr(34))"
    name_behind = f"{value} and {behind} and not {among(right, _BEHIND)} and not ({prefixed})"
    text_behind = f"{free} and starts_with({right}, chr(34))"
    twice = f"{left} in {tuple('-+*/%@&|^~<>=')} and {right} in {tuple('/%@&|^<>=')}"
    test = f"trim(toks[i], ' ' || chr(9)) = '' and (({name_behind}) or ({text_behind}) or ({twice}))"
    # The tokens are handed in as the one element of a list, so that they are found once.
    pairs = f"list_transform([{toks}], lambda toks: len(list_filter(range(2, len(toks)), lambda i: {test})) > 0)[1]"
    ending = strip(f"rtrim({strip('masked')}, ':')")
    return (f"({pairs} or right({ending}, 1) in {tuple('-+/%@&|^~=<>!')} or ({ending} like '%*' and not {has('masked', r'import\s*[*]\s*$')})"
            f" or {has('masked', r'[\p{L}_)\]}' + chr(34) + r'][.]\s*$')} or ({has('masked', rf'^\s*(?:{chr(124).join(_BLOCKS)})(?:[^\p{{L}}\p{{N}}_]|$)')} and not contains(masked, ':')))")


def _headers(name: str) -> dict[str, str]:
    """``{name}_sig``: signatures of definitions and classes from the bracket level of every character."""
    given = "(partition by corpus_id, path, stmt order by i)"
    note = f"trim(string_agg(t, '' order by i) filter (where i > colon and i < coalesce(equal, 1e9)), {WS_ALL})"
    return {
        **_characters(f"{name}_h", f"{name}_kinds", "kind in ('def', 'async def', 'class')"),
        f"{name}_paren": f"select {_KEY}, min(i) filter (where c = '(' and level = 0) as o, min(i) filter (where c = ':' and level = 0) as e from {name}_h group by all",
        f"{name}_shut": f"select {_KEY}, min(i) as p from {name}_h join {name}_paren using ({_KEY}) where c = ')' and level = 0 and i > o and o < e group by all",
        f"{name}_in": f"""select *, sum(cast(c = ',' and level = 1 as int)) over {given} as k from {name}_h join {name}_paren using ({_KEY})
            join {name}_shut using ({_KEY}) where i > o and i < p""",
        f"{name}_spot": f"select {_KEY}, k, min(i) filter (where c = ':' and level = 1) as colon, min(i) filter (where c = '=' and level = 1) as equal from {name}_in group by all",
        f"{name}_arg": f"""select {_KEY}, k, {strip("string_agg(t, '' order by i) filter (where not (c = ',' and level = 1))")} as raw,
            {strip("string_agg(t, '' order by i) filter (where not (c = ',' and level = 1) and i < least(coalesce(colon, 1e9), coalesce(equal, 1e9)))")} as called,
            {note} as note, any_value(equal) as equal from {name}_in join {name}_spot using ({_KEY}, k) group by {_KEY}, k""",
        f"{name}_stop": f"select {_KEY}, coalesce(max(k) filter (where raw = '/'), -1) as slash, coalesce(min(k) filter (where starts_with(raw, '*')), 1e9) as star from {name}_arg group by all",
        f"{name}_args": f"""select {_KEY}, string_agg(called, ', ' order by k) filter (where k > slash and k < star and raw <> '') as plain,
            string_agg(case when note <> '' then called || ': ' || {printed('note')} else called end, ', ' order by k) filter (where k > slash and k < star and raw <> '') as noted,
            string_agg({printed('raw')}, ', ' order by k) filter (where equal is null and raw <> '' and not starts_with(raw, '**')) as bases
            from {name}_arg join {name}_stop using ({_KEY}) group by all""",
        f"{name}_arrow": f"""select {_KEY}, {strip("substr(" + strip("string_agg(t, '' order by i)") + ", 3)")} as returned from {name}_h h join {name}_shut s using ({_KEY})
            where i > p and i < (select min(x.i) from {name}_h x where x.corpus_id = h.corpus_id and x.path = h.path and x.stmt = h.stmt and x.c = ':' and x.level = 0 and x.i > s.p) group by all""",
        f"{name}_sig0": f"""select k.corpus_id, k.path, k.stmt, kind, plain, noted, bases, {pick('masked', rf'(?:def|class)\s+({NAME})', 1)} as called,
            case when coalesce(returned, '') <> '' then ' -> ' || {printed('returned')} else '' end as arrow
            from {name}_kinds k left join {name}_args using ({_KEY}) left join {name}_arrow using ({_KEY}) where kind in ('def', 'async def', 'class')""",
        f"{name}_sig": f"""select {_KEY}, case when kind = 'class' then 'class ' || called || coalesce('(' || bases || ')', '') || ':'
            else 'def ' || called || '(' || coalesce(plain, '') || ')' || arrow end as sig,
            'def ' || called || '(' || coalesce(noted, '') || ')' || arrow as sig_noted from {name}_sig0""",
    }


def printed(x: str) -> str:
    text = sub(strip(x), r"\s+", lit(" "))
    text = sub(sub(text, " ?, ?", lit(", ")), r" ?\| ?", lit(" | "))
    return sub(text, r'"([^"\x27\\]*)"', "chr(39) || chr(92) || '1' || chr(39)")


def imported() -> str:
    flat = strip(sub("text", r"[\s\\]+", lit(" ")))
    plain = f"substr({flat}, 8)"
    # The module is what stands before the first word import.
    module = f"replace(substr(split_part(replace({flat}, 'import(', 'import ('), 'import ', 1), 5), ' ', '')"
    listed = f"translate(substr({flat}, strpos({flat}, 'import') + 6), '()', '  ')"

    def items(names, prefix):
        return each(where(each(f"string_split({names}, ',')", strip("x")), "x <> ''"), f"{prefix} || x")

    from_prefix = f"'from ' || {module} || ' import '"
    return (f"case when kind = 'import' then {items(plain, lit('import '))} "
            f"when kind = 'from' then {items(listed, from_prefix)} end")


def assigned(augmented: bool) -> str:
    text = "replace(masked, '==', chr(3))"
    chain = pick_all(pick(text, rf"^\s*((?:{NAME}[ \t]*=[ \t]*)+)", 1), NAME, 0)
    noted = pick(text, rf"^\s*({NAME})[ \t]*:", 1)
    grown = pick(text, rf"^\s*({NAME})[ \t]*(?:\*\*|//|>>|<<|[-+*/%@&|^])=", 1)
    more = f"when {grown} <> '' then [{grown}]" if augmented else ""
    return (f"case when kind <> 'other' then null when len({chain}) > 0 then {chain} "
            f"when {noted} <> '' and not {among(noted, _BLOCKS + ['lambda'])} then [{noted}] {more} end")


def definition_ctes(source: str, name: str) -> dict[str, str]:
    """``{name}_defs`` from the statements in ``name``: spans by the first later statement at most as deep."""
    is_def = "kind in ('def', 'async def')"
    return {
        f"{name}_seq": f"select * exclude (stmt), row_number() over (partition by corpus_id, path order by stmt) as stmt from {name} where stmt > 0",
        f"{name}_ends": f"""select d.corpus_id, d.path, d.stmt, min(s.stmt) as closer from {name}_seq d join {name}_seq s
            on d.corpus_id = s.corpus_id and d.path = s.path and s.stmt > d.stmt and s.indent <= d.indent
            where d.{is_def} group by all""",
        f"{name}_deco": f"""select d.corpus_id, d.path, d.stmt, coalesce(max(s.stmt), 0) as anchor from {name}_seq d left join {name}_seq s
            on d.corpus_id = s.corpus_id and d.path = s.path and s.stmt < d.stmt and s.kind <> 'decorator'
            where d.{is_def} group by all""",
        f"{name}_last": f"select corpus_id, path, max(stmt) as stmt from {name}_seq group by all",
        f"{name}_defs": f"""select d.corpus_id, d.path, {pick('d.text', rf'^\s*(?:async\s+)?def\s+({NAME})', 1)} as name,
            d.kind = 'async def' as is_async, d.start_line, tail.end_line, d.indent, d.sig_noted as signature,
            {strip(f"array_to_string(list_append(list_slice({lines(f'replace(f.content, chr(13) || chr(10), {NL})')}, top.start_line, tail.end_line - 1), {rstrip('tail.last_code')}), {NL})")} as source
            from {name}_seq d left join {name}_ends e using (corpus_id, path, stmt) join {name}_deco a using (corpus_id, path, stmt)
            join {name}_last z on d.corpus_id = z.corpus_id and d.path = z.path
            join {name}_seq tail on tail.corpus_id = d.corpus_id and tail.path = d.path and tail.stmt = coalesce(e.closer - 1, z.stmt)
            join {name}_seq top on top.corpus_id = d.corpus_id and top.path = d.path and top.stmt = a.anchor + 1
            join {source} f on f.corpus_id = d.corpus_id and f.path = d.path where d.{is_def}""",
    }


def owner_ctes(name: str) -> dict[str, str]:
    return {
        f"{name}_own0": f"select *, max(case when indent = 0 and stmt > 0 then stmt end) over (partition by corpus_id, path order by stmt) as owner from {name}",
        f"{name}_own": f"""select o.*, t.kind as owner_kind, t.sig as owner_sig, coalesce(t.kind = 'class' and o.stmt > o.owner and o.indent =
            arg_min(case when o.stmt > o.owner then o.indent end, case when o.stmt > o.owner then o.stmt end) over (partition by o.corpus_id, o.path, o.owner), false) as class_item
            from {name}_own0 o left join {name} t on o.corpus_id = t.corpus_id and o.path = t.path and o.owner = t.stmt""",
    }


def skeleton_ctes(name: str) -> dict[str, str]:
    """``{name}_skel`` (corpus_id, path, skeleton) from the statements in ``name``."""
    def rows(section, a, b, value, test):
        return f"select corpus_id, path, {section} as section, {a} as a, {b} as b, {value} as value from {name}_own where {test}"

    def unnested(section, a, values, value, test):
        return (f"select corpus_id, path, {section} as section, {a} as a, stmt * 10000.0 + i as b, {value} as value from "
                f"(select *, unnest(range(len(vals))) as i, unnest(vals) as v from (select *, {values} as vals from {name}_own where {test}))")

    top = "indent = 0 and stmt > 0"
    imports = unnested(0, "indent", imported(), "v", "kind in ('import', 'from')")
    variables = unnested(1, 0, assigned(True), "v || ' = ...'", f"{top} and kind = 'other'")
    functions = rows(2, "stmt", 0, f"sig || ':' || {NL} || '    ...' || {NL}", f"{top} and kind = 'def'")
    heads = rows(3, "owner", -2, "sig", f"{top} and kind = 'class'")
    tails = rows(3, "owner", "9e30", "''", f"{top} and kind = 'class'")
    fields = unnested(3, "owner", assigned(False), "'    ' || v || ' = ...'", "class_item and kind = 'other'")
    methods = rows(3, "owner", "1e20 + stmt", f"'    ' || sig || ':' || {NL} || '        ...'",
                   "class_item and kind = 'def'")
    return {
        f"{name}_items": " union all ".join(f"({q})" for q in (imports, functions, heads, tails, fields, methods)),
        f"{name}_vars": f"select corpus_id, path, 1 as section, 0 as a, min(b) as b, value from ({variables}) group by all",
        f"{name}_both": f"select * from {name}_items union all select * from {name}_vars",
        f"{name}_skel": f"""select corpus_id, path, concat(
            string_agg(value, {NL} order by a, b) filter (where section = 0), case when bool_or(section = 0) and bool_or(section > 0) then {NL} || {NL} when bool_or(section = 0) then {NL} end,
            string_agg(value, {NL} order by a, b) filter (where section = 1), case when bool_or(section = 1) and bool_or(section > 1) then {NL} || {NL} when bool_or(section = 1) then {NL} end,
            string_agg(value, {NL} order by section, a, b) filter (where section > 1),
            {NL} || '# ... (Structure extracted via AST - code_outline.py)') as skeleton
            from (select distinct corpus_id, path from {name}) left join {name}_both using (corpus_id, path) group by corpus_id, path""",
    }


def opened(text: str) -> str:
    return where(each(splitlines(text), strip("x")), starts("x", DEFINITION_STARTS))

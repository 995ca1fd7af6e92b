"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

from quakeframe.llm.decontamination import LEAST, WINDOW
from quakeframe.llm.quality import POLICIES
from quakeframe.llm.quality import RULES as QUALITY_RULES
from quakeframe.llm.secret_scan import BASE_RULES, RULES


def _op9() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(f"""select doc_id, n, {rank} as rank, '{r.kind}' as kind, unnest(list_transform(range(1, len(hit) + 1), lambda k: {{
            'part': part[k], 'hit': hit[k], 'start': list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:k-1], lambda x: length(x))), 0)}})) as s, {r.least} as least
          from (select doc_id, n, regexp_extract_all(text, {p}) as hit, regexp_extract_all(text, {p}, {r.group}) as part, regexp_split_to_array(text, {p}) as gap from d)""")
    base = ", ".join(quoted(r.kind) for r in BASE_RULES)
    return f"""with d as (select doc_id, coalesce(text, '') as text, row_number() over () as n from documents),
    found as (select doc_id, n, rank, kind, s.start as a, s.start + length(s.hit) as z from ({" union all ".join(parts)}) where length(s.part) >= least),
    said as (select n, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      coalesce(string_agg(kind || ':' || cast(a as bigint) || ':' || cast(z as bigint), ',' order by a, rank) filter (kind in ({base})), '') as base,
      string_agg(kind || ':' || cast(a as bigint) || ':' || cast(z as bigint), ',' order by a, rank) as spans from found group by n)
    select d.doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex,
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join said on d.n = said.n"""


OP8 = r"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as n from documents),
w as (select n, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '')) as w, generate_subscripts(list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> ''), 1) as k from d),
g as (select n, k, w || ' ' || lead(w) over r || ' ' || lead(w, 2) over r as g from w window r as (partition by n order by k)),
again as (select n, k from (select n, k, count(*) over (partition by n, g) as c from g where g is not null) where c > 1),
inside as (select n, count(distinct k + j) as n_repeat_words from again, (values (0), (1), (2)) as j(j) group by n),
words as (select n, count(*) as n_words, sum(length(w)) as word_chars from w group by n),
lines as (select n, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from (select n, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^ \t\n\v\f\r]') group by n),
m as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines
  from d left join words using (n) left join lines using (n) left join inside using (n)),
b as (select *, case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when n_words > 1000000 then 4 else 0 end
  + case when word_chars < 2 * n_words then 8 else 0 end + case when word_chars > 20 * n_words then 16 else 0 end + case when 10 * n_symbols > 3 * word_chars then 32 else 0 end
  + case when n_lines >= 4 and 10 * n_dup_lines > 6 * n_lines then 64 else 0 end as bits from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, (bits & 3) <> 0 as base_failed, bits = 0 as kept, cast(bits as bigint) as fail_bits from b
"""

def _op1() -> str:
    """Every diagonal of every document and item that agrees in enough tokens at all, and every window on it; no seeds."""
    listed = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    return f"""with items as (select item_id as id, {listed} as t from benchmark where len({listed}) > 0),
    docs as (select doc_id as id, {listed} as t from documents),
    item_words as (select id, least({WINDOW}, len(t)) as n, unnest(t) as w, generate_subscripts(t, 1) as k from items),
    doc_words as (select * from (select id, unnest(t) as w, generate_subscripts(t, 1) as k from docs) where w in (select w from item_words)),
    diagonal as (select d.id as doc_id, i.id as item_id, d.k - i.k as shift from doc_words d join item_words i using (w) group by d.id, i.id, d.k - i.k, i.n having count(*) >= ceil(i.n * {LEAST})),
    lined as (select doc_id, item_id, shift, d.t as dt, i.t as it, least({WINDOW}, len(i.t)) as n, greatest(0, -shift) as lo, least(len(i.t), len(d.t) - shift) as hi from diagonal join docs d on d.id = doc_id join items i on i.id = item_id),
    starts as (select *, unnest(range(lo, hi - n + 1)) as s from lined),
    judged as (select doc_id, item_id, n as n_compared, s + shift as position, len(list_filter(range(s, s + n), lambda k: dt[k + shift + 1] = it[k + 1])) as n_same from starts),
    ranked as (select *, row_number() over (partition by doc_id, item_id order by n_same desc, n_compared desc, position) as r from judged)
    select doc_id, item_id, cast(n_same as integer) as n_same, cast(n_compared as integer) as n_compared, cast(position as integer) as position from ranked where r = 1 and n_same >= ceil(n_compared * {LEAST})"""


def _ablation() -> str:
    used = ", ".join(f"('{p}', {v}, {mask}, {r.bit}, '{r.name}')" for (p, v), mask in POLICIES.items() for r in QUALITY_RULES if mask >> r.bit & 1)
    bits = OP8.strip().removeprefix("with").rsplit("\nselect", 1)[0]
    return f"""with {bits}, t as (select bit_or(bits) as any_bits, bit_and(bits) as all_bits from b),
    u(policy, version, mask, bit, rule) as (values {used})
    select policy, version, bit, rule, count(*) filter ((bits >> bit) & 1 = 1) as n_fail, count(*) filter ((bits & mask) = (1 << bit)) as n_only,
      count(*) filter ((bits & mask & ~(1 << bit)) = 0) as n_kept_without, cast(max(any_bits) as bigint) as any_bits, cast(max(all_bits) as bigint) as all_bits from b, u, t group by policy, version, bit, rule"""


OP4 = """
with d as (select page_id, coalesce(html, '') as html from pages),
h as (select *, sha1(html) as hex, max(page_id) over (partition by html) as latest from d),
c as (select *, list_transform(range(0, 8), lambda k: cast('0x' || substr(hex, 5 * k + 1, 5) as bigint)) as parts from h),
e as (select *, list_aggregate(list_transform(parts, lambda v: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v >> s) & 31 as integer) + 1, 1)), 'string_agg', '')), 'string_agg', '') as digest from c)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, digest as payload_digest, case when page_id is not distinct from latest then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from latest then latest end as refers_to from e
"""


def _op12(levels: int = 14) -> str:
    """The trees level by level (for up to 3^14 documents of a source), and every leaf folded along them."""
    h = lambda *c: "concat(" + ", ".join(f"case when {x} is null then '-' else concat(octet_length(encode(cast({x} as varchar))), ':', {x}) end" for x in c) + ")"
    def tree(base: str, key: str) -> str:
        out = []
        for k in range(1, levels + 1):
            low = base if k == 1 else f"{base}{k - 1}"
            out.append(f"{base}{k} as materialized (select {key}, i // 3 as i, max((n + 2) // 3) as n, sha256(string_agg(h, '' order by i)) as h, list(h order by i) as kids from {low} where n > 1 group by {key}, i // 3)")
        return ", ".join(out)

    def fold(base: str, key: str, row: str, to: str) -> str:
        """``row`` (with i, cur, sib) taken up the tree; nodes on top stay as they are."""
        out = []
        for k in range(1, levels + 1):
            low = row if k == 1 else f"{to}{k - 1}"
            kids = f"list_transform(range(1, len(t.kids) + 1), lambda q: case when q = r.i % 3 + 1 then r.cur else t.kids[q] end)"
            sibs = f"list_transform(list_filter(range(1, len(t.kids) + 1), lambda q: q <> r.i % 3 + 1), lambda q: t.kids[q])"
            out.append(f"{to}{k} as materialized (select r.* exclude (i, cur, sib), coalesce(t.i, r.i) as i, case when t.i is null then r.cur else sha256(array_to_string({kids}, '')) end as cur, case when t.i is null then r.sib else concat(r.sib, array_to_string({sibs}, '')) end as sib from {low} r left join {base}{k} t on t.{key} = r.{key} and t.i = r.i // 3)")
        return ", ".join(out)

    steps = "[" + "-1, " * 7 + "-1]"
    return f"""with d as (select *, coalesce('=' || source, '') as tree, xor(list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: list_prepend(cast(ord(c) as bigint), {steps})))),
        lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, case when a & 1 = 1 then cast(3988292384 as bigint) else 0 end) end), cast(4294967295 as bigint)) as crc from documents),
    l as (select doc_id, tree, sha256({h('doc_id', 'source', 'lang', 'n_chars', 'text')}) as h, sha256({h('doc_id', 'source', 'lang', 'n_chars', "(case when crc % 2 = 0 then replace(text, chr(10), '') else text end)")}) as other from d),
    b as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as i, count(*) over (partition by tree) as n from l),
    {tree("b", "tree")},
    subs as ({" union all ".join(f"select tree, h from b{k or ''} where n = 1" for k in range(levels + 1))}),
    f as materialized (select 0 as one, tree, h, row_number() over (order by tree) - 1 as i, count(*) over () as n from subs),
    {tree("f", "one")},
    root as ({" union all ".join(f"select h from f{k or ''} where n = 1" for k in range(levels + 1))}),
    r0 as (select doc_id, tree, h as leaf, i, other as cur, '' as sib from b),
    {fold("b", "tree", "r0", "u")},
    q0 as (select u.doc_id, u.leaf, f.h as subroot, u.cur, u.sib, f.i, 0 as one from u{levels} u join f using (tree)),
    {fold("f", "one", "q0", "v")}
    select doc_id, leaf, subroot, root.h as root, sha256(sib) as proof_sha256, cur as folded_root, cur = root.h as verified from v{levels}, root"""


ORACLE_SQL = {"op1_decontamination": _op1(), "op4_warc": OP4, "op8_quality_rules": OP8, "op9_secret_scan": _op9(), "op12_merkle": _op12(), "quality_ablation": _ablation()}

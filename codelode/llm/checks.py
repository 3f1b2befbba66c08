"""DuckDB SQL for the queries of this folder that SQL can express. Fixed values are written out
again here, so that a wrong one in an operator shows."""

CHECKS: dict[str, str] = {}

CHECKS["op2_quality_rules"] = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (
  select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from docs),
lines as (
  select r, unnest(generate_series(1, len(ls))) as i, unnest(ls) as line
  from (select r, string_split(text, chr(10)) as ls from docs)),
parts as (
  select r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from lines),
measured as (
  select r, i, line, len(ws) as n, list_sum(list_transform(ws, lambda w: length(w))) as chars,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as symbols,
    len(list_filter(ws, lambda w: ends_with(w, '!!'))) as shouts,
    len(list_filter(ws, lambda w: w in ('|', '»', '›', '·', '•', '/', '>'))) as bars,
    lower(line) as low
  from parts where len(ws) > 0),
judged as (
  select r, chars, row_number() over (partition by r, line order by i) > 1 as again,
    (n > 8 and not regexp_matches(line, '[.!?…:;‼‽⁇⁈⁉。！？：；．｡।॥؟۔؛։።፣፤፧។៕៖၊။།༎᠃᠉\x{0e01}-\x{0edf}]')) or symbols * 10 > chars
    or (shouts >= 3 and shouts * 4 >= n) or (bars >= 3 and bars * 6 >= n)
    or contains(low, 'all rights reserved') or contains(low, 'licensed under')
    or contains(low, 'released under the') or contains(low, 'privacy policy')
    or contains(low, 'terms of use') or contains(low, 'terms of service')
    or contains(low, 'cookie policy') or contains(low, 'enable javascript')
    or contains(low, 'subscribe to our newsletter') or contains(low, 'click here')
    or contains(low, 'tous droits réservés') or contains(low, 'politique de confidentialité')
    or contains(low, 'conditions d''utilisation') or contains(low, 'mentions légales')
    or contains(low, 'activez javascript') or contains(low, 'cliquez ici')
    or contains(low, 'alle rechte vorbehalten') or contains(low, 'datenschutzerklärung')
    or contains(low, 'nutzungsbedingungen') or contains(low, 'allgemeine geschäftsbedingungen')
    or contains(low, 'javascript aktivieren') or contains(low, 'klicken sie hier')
    or contains(low, 'hier klicken') or contains(low, 'todos los derechos reservados')
    or contains(low, 'política de privacidad') or contains(low, 'términos de uso')
    or contains(low, 'condiciones de uso') or contains(low, 'aviso legal')
    or contains(low, 'active javascript') or contains(low, 'haga clic aquí') as fails
  from measured),
by_doc as (
  select r, sum(chars) as chars, sum(case when again then 1 else 0 end) as dups,
    sum(case when fails then chars else 0 end) as lost
  from judged group by r),
windows as (
  select r, pos, ws[pos] || ' ' || ws[pos + 1] || ' ' || ws[pos + 2] || ' ' || ws[pos + 3] || ' '
    || ws[pos + 4] as w
  from (select r, ws, unnest(generate_series(1, len(ws) - 4)) as pos from words where len(ws) > 4)),
twice as (
  select r, pos from (select r, pos, count(*) over (partition by r, w) as n from windows) where n > 1),
covered as (
  select r, count(distinct pos + k) as n from twice, generate_series(0, 4) as g(k) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(b.chars, 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(b.dups, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
  len(ws) < 10 or 100 * coalesce(c.n, 0) > 20 * len(ws) as base_failed,
  not (len(ws) < 10 or 100 * coalesce(c.n, 0) > 20 * len(ws))
    and 2 * coalesce(b.lost, 0) <= coalesce(b.chars, 0) as kept
from words w left join by_doc b on b.r = w.r left join covered c on c.r = w.r
"""

CHECKS["op3_mixing"] = r"""
with recursive sized as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sources as (
  select source, size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight
  from (select source, sum(size)::bigint as size from sized group by source)),
shares(round, source, size, weight, target, full_) as (
  select 0, source, size, weight,
    (weight * (select sum(size) from sources))::double / (select sum(weight) from sources)::double,
    false
  from sources
  union all
  select round + 1, source, size, weight,
    case when stop then (3 * size)::double
      else (weight * (total - sum(case when stop then 3 * size else 0 end) over ()))::double
        / (sum(case when stop then 0 else weight end) over ())::double end, stop
  from (select *, full_ or target > 3 * size as stop, sum(size) over () as total,
          max(case when not full_ and target > 3 * size then 1 else 0 end) over () as more
        from shares)
  where more = 1),
targets as (
  select coalesce('s' || source, 'null') as src, size as source_size, target from shares
  where round = (select max(round) from shares)),
weighed as (
  select doc_id, size, coalesce('s' || source, 'null') as src,
    ceil(least(size, 200) / 20.0)::bigint as weight from sized),
levels as (
  select src, weight, sum(size)::bigint as words from weighed where weight > 0 group by src, weight),
rates as (
  select src, weight,
    target - (3 * coalesce(sum(words) over (partition by src order by weight desc
      rows between unbounded preceding and 1 preceding), 0))::double as wanted,
    (sum(words * weight) over (partition by src order by weight desc
      rows between current row and unbounded following))::double as weighted
  from levels join targets using (src)),
rate as (
  select src, max_by(wanted / weighted, weight) as rate from rates
  where wanted / weighted * weight <= 3 group by src),
expected as (
  select w.*, source_size, target, case when weight = 0 then 0::double when rate is null then 3::double
    else least(3::double, rate * weight) end as expected
  from weighed w join targets using (src) left join rate using (src)),
odds as (
  select *, floor(expected) as whole, expected - floor(expected) as chance,
    (('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5)
      / 4503599627370496.0 as u,
    target - sum(floor(expected) * size) over (partition by src) as rest
  from expected),
placed as (
  select *, coalesce(sum(size) over (partition by src
      order by (u / (1 - u)) / (chance / (1 - chance)), doc_id, size
      rows between unbounded preceding and 1 preceding), 0) as before
  from odds where chance > 0
  union all select *, 0 from odds where not chance > 0)
select doc_id, size, source_size, target,
  (whole * size + case when chance > 0 and before + size / 2.0 <= rest then size else 0 end)::bigint
    as taken, weight, chance
from placed
"""

CHECKS["op5_exact_dedup"] = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

CHECKS["op10_chat"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
longer as (
  select *, length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) as role_chars,
    length(regexp_replace(text, '[\\#<]', 'xx', 'g')) as text_chars from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, ''
    order by turn, role, text), '')) as loss_sha256,
  sum(4 + role_chars + 2 + text_chars + 9)::bigint as formatted_chars
from longer group by conv_id
"""

_FIELD = "case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0}::varchar end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in (
    "doc_id", "source", "lang", "n_chars", "{0}")) + ")"
CHECKS["op13_merkle"] = f"""
with recursive docs as (
  select doc_id, lang, {_LEAF.format("text")} as leaf,
    {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      as changed,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''),
      lambda c: ascii(c)::bigint)), lambda crc, byte: list_reduce(
        [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))) as crc
  from documents),
leaves as (
  select row_number() over () as r, *, dense_rank() over (order by lang nulls first) - 1 as tree,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
    xor(crc, 4294967295) % 3 = 0 as tampered from docs),
low(level, tree, pos, digest) as (
  select 0, tree, pos, leaf from leaves
  union all
  select level + 1, tree, pos // 8, sha256(string_agg(digest, '' order by pos))
  from (select *, count(*) over (partition by tree) as n from low)
  where n > 1 group by level, tree, pos // 8),
heights as (select tree, max(level) as height from low group by tree),
subroots as (select tree, height, digest from low join heights using (tree) where level = height),
top(level, pos, digest) as (
  select 0, tree, digest from subroots
  union all
  select level + 1, pos // 8, sha256(string_agg(digest, '' order by pos))
  from (select *, count(*) over () as n from top) where n > 1 group by level, pos // 8),
steps as (
  select r, level, own_pos % 8 as place, list(digest order by l.pos) as run
  from (select r, tree, level, pos // (8 ** level)::bigint as own_pos
        from leaves join heights using (tree), generate_series(0, height - 1) as g(level)) o
  join low l using (level, tree) where l.pos // 8 = own_pos // 8 group by r, level, own_pos
  union all
  select r, height + level, own_pos % 8, list(digest order by t.pos)
  from (select r, height, level, tree // (8 ** level)::bigint as own_pos
        from leaves join heights using (tree),
          generate_series(0, (select max(level) from top) - 1) as g(level)) o
  join top t using (level) where t.pos // 8 = own_pos // 8 group by r, height, level, own_pos),
fold(r, level, own) as (
  select r, 0, case when tampered and changed is not null then changed else leaf end from leaves
  union all
  select r, level + 1, sha256(array_to_string(run[:place], '') || own
    || array_to_string(run[place + 2:], ''))
  from fold join steps using (r, level)),
folded as (select r, arg_max(own, level) as folded_root from fold group by r),
proofs as (
  select r, string_agg(array_to_string(run[:place], '') || array_to_string(run[place + 2:], ''), ''
    order by level) as proof from steps group by r)
select doc_id, leaf, subroots.digest as subroot, t.digest as root,
  sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = t.digest as verified
from leaves join subroots using (tree) join folded using (r) left join proofs using (r),
  (select digest from top order by level desc limit 1) t
"""

CHECKS["op11_embeddings"] = """
with recursive given as (
  select row_number() over () as r, vec_id, embedding::double[] as v from embeddings),
units as (
  select r, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from given
  where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
links as (
  select x.r as a, y.r as b from units x, units y
  where x.r <> y.r and len(x.v) = len(y.v) and x.norm > 0 and y.norm > 0
    and list_dot_product(x.v, y.v) / x.norm / y.norm >= 0.9),
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(other, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(other, vec_id)) as kept
from given left join (select a, count(*) as n from links group by a) l on l.a = r
  left join (select reach.a, min(vec_id) as other from reach join given g on g.r = reach.b group by reach.a) m
    on m.a = r
"""

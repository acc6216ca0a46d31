"""DuckDB SQL for rendered messages, put together from the same texts."""

from __future__ import annotations

from ledeforge.functions import render
from ledeforge.functions import vocabulary as V
from ledeforge.functions.scoring import weights_for
from ledeforge.plans import messages as M
from ledeforge.plans import sql
from ledeforge.plans.sql import q


def esc(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def fixed(c: str, places: int) -> str:
    return f"round(({c} + {render.TIE!r})::DECIMAL(18, 9), {places})::DECIMAL(18, {places})::VARCHAR"


def text(s: str) -> str:
    return q(s).replace("\n", "' || chr(10) || '")


def lookup(key: str, pairs: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {text(v)}" for k, v in pairs.items()) + " END"


NL = " || chr(10) || "
GAP = " || chr(10) || chr(10) || "
BADGES = {c: f"{V.CATEGORY_EMOJI[c]} {V.CATEGORY_LABELS[c].split(' &')[0]}" for c in V.CATEGORIES}
BADGE = f"coalesce({lookup('cat', BADGES)}, '📰 General')"
BAND = f"CASE WHEN round(score + 1e-9, 2) >= {V.STRONG_AT} THEN 'Strong' WHEN round(score + 1e-9, 2) >= {V.NOTABLE_AT} THEN 'Notable' ELSE 'Context' END"
AGE = f"CASE WHEN {sql.AGE} < 1 THEN trunc({sql.AGE} * 60)::INT || 'm ago' WHEN {sql.AGE} < 24 THEN trunc({sql.AGE})::INT || 'h ago' ELSE trunc({sql.AGE} / 24)::INT || 'd ago' END"
OUTLETS = "CASE WHEN source_count = 2 THEN '+1 outlet agrees' WHEN source_count > 2 THEN '+' || (source_count - 1) || ' outlets agree' END"
LINK = f"'<a href=\"' || {esc('url')} || '\">' || {esc('title')} || '</a>'"
SOURCE = f"'<i>' || concat_ws(' · ', {esc('source')}, {OUTLETS}, {AGE}) || '</i>'"


def entry(rank: str) -> str:
    return f"'<b>' || {rank} || '</b>  ' || {BAND} || ' <code>' || {fixed('score', 2)} || '</code>  ·  ' || {BADGE}{NL}{LINK}{NL}{SOURCE}"


RECENT = f"round(greatest(0.0::DOUBLE, {sql.AGE})::DECIMAL(18, 9), 1)::DECIMAL(18, 1)::VARCHAR || 'h old'"


def drivers(weights: dict[str, float]) -> str:
    """All factors as a list of structs, by contribution; equal ones in table order."""
    why = sql.WHY | {"recency": RECENT}
    one = [f"{{'k': -(raw_{n} * {w!r}::DOUBLE), 'o': {k}, 'n': {q(n)}, 'raw': raw_{n}, 'w': {w!r}::DOUBLE, 'c': raw_{n} * {w!r}::DOUBLE, 'why': {why[n]}}}" for k, (n, w) in enumerate(weights.items())]
    return f"list_sort([{', '.join(one)}])"


def why_line() -> str:
    return f"rpad(f.n, 15, ' ') || {fixed('f.raw', 2)} || ' x ' || {fixed('f.w', 3)} || ' = ' || {fixed('f.c', 3)} || '  ' || f.why"


def alert(threshold: str, digest_time: str = V.DIGEST_TIME) -> str:
    """Over rows with the sorted list ``fs``; its messages are far below the limit."""
    reason = f"'<i>This scored <b>' || {fixed('score', 2)} || '</b>, above your alert level of ' || {fixed(threshold, 2)} || ': it comes now instead of waiting for the {digest_time} briefing.</i>'{NL}'<i>Mostly on ' || fs[1].n || ', ' || fs[2].n || '.</i>'"
    return f"{text('🚨 <b>Sent early</b>')}{GAP}{q(render.RULE)}{GAP}{BADGE}{NL}{LINK}{GAP}{SOURCE}{GAP}{q(render.RULE)}{GAP}{reason}"


def why(place: str) -> str:
    """Over rows with the sorted list ``fs`` and their weakest factor ``least``."""
    cell = lambda c, places, width: f"lpad({fixed(c, places)}, {width}, ' ')"
    row = f"rpad(f.n, 15, ' ') || {cell('f.raw', 2, 6)} || {cell('f.w', 3, 7)} || {cell('f.c', 3, 7)}"
    top = f"<pre>\n{'factor':<15}{'raw':>6}{'wt':>7}{'adds':>7}\n{render.THIN}\n"
    table = f"{text(top)} || array_to_string(list_transform(fs, lambda f: {row}), chr(10)) || {text(chr(10) + render.THIN + chr(10) + f'{"TOTAL":<28}')} || {cell('score', 3, 7)} || {text(chr(10) + '</pre>')}"
    told = lambda f: f"'▸ <b>' || {esc(f + '.n')} || '</b>: ' || {esc(f + '.why')}"
    drove = f"'<b>What drove it</b>'{NL}array_to_string(list_transform(fs[1:3], lambda f: {told('f')}), chr(10))"
    held = f"'<b>What held it back</b>'{NL}{told('least')}"
    return f"'🔍 <b>Why #' || {place} || ' scored ' || {fixed('score', 3)} || '</b>'{GAP}{LINK}{NL}{SOURCE}{GAP}{q(render.RULE)}{GAP}{table}{GAP}{drove}{GAP}{held}"


#: Of the factors, the smallest contribution and the first among equals.
LEAST = "list_sort(list_transform(fs, lambda f: {'c': f.c, 'o': f.o, 'n': f.n, 'why': f.why}))[1]"

READERS = f"""rd0 AS (
  SELECT DISTINCT user_id::BIGINT AS chat_id, list_filter([{', '.join(f"CASE WHEN (user_id >> {k}) & 1 = 1 THEN {q(c)} END" for k, c in enumerate(V.CATEGORIES))}], lambda x: x IS NOT NULL) AS bits,
         {sql.lst(list(V.DEPTH_SPLITS))}[user_id % {len(V.DEPTH_SPLITS)} + 1] AS depth FROM events WHERE user_id IS NOT NULL),
rd AS (SELECT chat_id, depth, list_sort(CASE WHEN len(bits) = 0 THEN {sql.lst(V.CATEGORIES)} ELSE bits END) AS cats FROM rd0),
rs AS (SELECT *, array_to_string(cats, ',') || '|' || depth AS sign FROM rd),
sg AS (SELECT DISTINCT sign, cats, depth FROM rs)"""


def ranked(lo: str, hi: str) -> str:
    """The selected items of every signature, over ``fa`` and ``sg``."""
    score = "CASE s.depth " + " ".join(f"WHEN {q(d)} THEN {sql.total(weights_for(d))}" for d in V.DEPTH_SPLITS) + " END"
    return f"""sc AS (SELECT s.sign, s.cats, s.depth, fa.*, {score} AS score FROM fa JOIN sg s ON len(s.cats) = {len(V.CATEGORIES)} OR list_contains(s.cats, fa.cat)),
{sql.selected('sign, bucket', lo, hi)},
rk AS (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY score DESC, bucket, seq) AS rank FROM sel)"""


def notes() -> str:
    names = f"array_to_string(list_transform(list_filter({sql.lst(V.CATEGORIES)}, lambda c: list_contains(cats, c)), lambda c: {lookup('c', BADGES)}), ', ')"
    scope = f"CASE WHEN len(cats) = {len(V.CATEGORIES)} THEN '' ELSE '<i>Filtered to ' || {names} || CASE WHEN before > 0 THEN ' — ' || after || ' of ' || before || ' stories matched' ELSE '' END || '. /weights to widen.</i>' END"
    carried = "CASE WHEN depth = 'analysis' THEN analysis ELSE numeric_ END"
    said = f"CASE WHEN depth = 'balanced' OR n = 0 OR {carried} >= greatest(1, n // 2) THEN '' ELSE '<i>Only ' || {carried} || ' of ' || n || ' stories carry ' || CASE WHEN depth = 'analysis' THEN 'analyst framing' ELSE 'hard figures' END || ' today, so ' || CASE WHEN depth = 'analysis' THEN 'Analysis' ELSE 'Numbers' END || ' had little to reorder.</i>' END"
    return f"""pl AS (SELECT sign, (SELECT count(*) FROM fa) AS before, count(seq) AS after FROM sg LEFT JOIN fa ON len(cats) = {len(V.CATEGORIES)} OR list_contains(cats, cat) GROUP BY sign),
cn AS (SELECT sign, count(*) AS n, count(*) FILTER (WHERE raw_numeric > 0) AS numeric_, count(*) FILTER (WHERE raw_analysis > 0) AS analysis, max(title) FILTER (WHERE rank = 1) AS lead_ FROM rk GROUP BY sign),
nt0 AS (SELECT sg.*, before, after, coalesce(n, 0) AS n, coalesce(numeric_, 0) AS numeric_, coalesce(analysis, 0) AS analysis, lead_ FROM sg JOIN pl USING (sign) LEFT JOIN cn USING (sign)),
nt AS (SELECT *, {scope} AS scope, {said} AS depth_said FROM nt0)"""


def top_blocks(limit: int = 10) -> str:
    return " UNION ALL ".join([
        f"SELECT sign, {M.HEAD} AS ord, {text(M.EMPTY_TOP)} AS t FROM nt WHERE n = 0",
        f"SELECT sign, {M.HEAD}, {text(chr(10).join(('🏆 <b>Top stories</b>', '<i>your weights · ')))} || {lookup('depth', {d: n.lower() for d, n in V.DEPTH_LABELS.items()})} || '</i>' FROM nt WHERE n > 0",
        *(f"SELECT sign, {at}, {text(t)} FROM nt WHERE n > 0" for at, t in ((M.OPENING, render.RULE), (M.AFTER, render.RULE), (M.AFTER + 3, render.LEGEND), (M.AFTER + 4, M.TOP_FOOT))),
        f"SELECT sign, {M.ENTRIES} + rank, {entry('rank')} FROM rk WHERE rank <= {limit}",
        f"SELECT sign, {M.AFTER + 1}, scope FROM nt WHERE n > 0", f"SELECT sign, {M.AFTER + 2}, depth_said FROM nt WHERE n > 0",
    ])


def digest_blocks(market: str) -> str:
    return " UNION ALL ".join([
        f"SELECT sign, {M.HEAD} AS ord, {text(chr(10).join(('📊 <b>Your briefing</b>', '<i>')))} || strftime({sql.NOW} + INTERVAL 8 HOUR, '%d %b · %H:%M') || '</i>' AS t FROM nt",
        f"SELECT sign, {M.STORY}, '<b>' || {esc(f'coalesce(lead_, {q(M.NO_STORY)})')} || '</b>' FROM nt",
        f"SELECT sign, {M.BULLETS} + rank, '▸ ' || {esc("title || ' (' || source || ')'")} FROM rk WHERE rank <= {V.FALLBACK_BULLETS}",
        f"SELECT sign, {M.ENTRIES} + rank, {entry('rank')} FROM rk",
        *(f"SELECT sign, {at}, {text(t)} FROM nt WHERE n > 0" for at, t in ((M.CLOSING, render.RULE), (M.SOURCES, "<b>Sources</b>"), (M.AFTER + 5, M.NO_MODEL))),
        *(f"SELECT sign, {at}, {t} FROM nt" for at, t in ((M.OPENING, q(render.RULE)), (M.AFTER, q(render.RULE)), (M.AFTER + 1, market), (M.AFTER + 2, q(render.RULE)), (M.AFTER + 3, "scope"), (M.AFTER + 4, q(render.LEGEND)))),
    ])


def packed(blocks: str, limit: int = V.MESSAGE_LIMIT) -> str:
    """(list of messages) of an ordered list of blocks that fit each."""
    joined = f"{{'parts': a.parts, 'now': a.now{GAP}b.now}}"
    step = f"CASE WHEN length(a.now) + 2 + length(b.now) <= {limit} THEN {joined} ELSE {{'parts': list_append(a.parts, a.now), 'now': b.now}} END"
    return f"list_reduce(list_transform({blocks}, lambda t: {{'parts': []::VARCHAR[], 'now': t}}), lambda a, b: {step})"


def sent(blocks: str) -> str:
    return f"""bl AS ({blocks}),
ls AS (SELECT sign, list(t ORDER BY ord) AS l FROM bl WHERE t <> '' GROUP BY sign),
ms AS (SELECT sign, {packed('l')} AS m FROM ls),
parts AS (SELECT sign, list_append(m.parts, m.now) AS p FROM ms),
each AS (SELECT sign, unnest(range(len(p))) AS k, p FROM parts)
SELECT chat_id, k::INT AS part, p[k + 1] AS text FROM rs JOIN each USING (sign)"""


def settings() -> str:
    each = NL.join(f"CASE WHEN list_contains(cats, {q(c)}) THEN '🟢' ELSE '⚪️' END || {text(f'  {V.CATEGORY_EMOJI[c]} <b>{render._escaped(V.CATEGORY_LABELS[c])}</b>' + chr(10) + f'      <i>{render._escaped(V.CATEGORY_BLURBS[c])}</i>')}" for c in V.CATEGORIES)
    shown = lookup("depth", {d: f"<b>Depth</b>\n<i>{V.DEPTH_BLURBS[d]}</i>\n\n▸ <b>{V.DEPTH_LABELS[d]}</b>" for d in V.DEPTH_SPLITS})
    formula = lookup("depth", {d: "<b>Your formula</b>\n<i>every story scores against this</i>\n\n<pre>\n" + "\n".join(render.weight_lines(weights_for(d))) + "\n</pre>\n<i>← set by your depth</i>" for d in V.DEPTH_SPLITS})
    rule = q(render.RULE)
    return f"{text('⚖️ <b>Your settings</b>')}{GAP}{rule}{GAP}{text('<b>Categories</b>' + chr(10) + '<i>which subjects reach you</i>' + chr(10) + chr(10))} || {each}{GAP}{rule}{GAP}{shown}{GAP}{rule}{GAP}{formula}"


def split(doc: str, limit: int = V.MESSAGE_LIMIT) -> str:
    """The messages of a text: blocks between blank lines, larger ones cut hard."""
    cut = f"flatten(list_transform(string_split({doc}, chr(10) || chr(10)), lambda b: CASE WHEN length(b) <= {limit} THEN [b] ELSE list_transform(range((length(b) - 1) // {limit} + 1), lambda k: substr(b, k * {limit} + 1, {limit})) END))"
    joined = f"{{'parts': a.parts, 'now': a.now{GAP}b.now}}"
    step = f"CASE WHEN a.now = '' THEN {{'parts': a.parts, 'now': b.now}} WHEN length(a.now) + 2 + length(b.now) <= {limit} THEN {joined} ELSE {{'parts': list_append(a.parts, a.now), 'now': b.now}} END"
    folded = f"list_reduce(list_transform({cut}, lambda t: {{'parts': []::VARCHAR[], 'now': t}}), lambda a, b: {step})"
    return f"CASE WHEN length({doc}) <= {limit} THEN [{doc}] ELSE (SELECT list_filter(list_append(m.parts, m.now), lambda p: p <> '') FROM (SELECT {folded} AS m)) END"

"""Pieces of DuckDB SQL for the oracles of the registered queries."""

from __future__ import annotations

# Fixed values, written out once more so that the SQL does not repeat a mistake of the engine.
VACANT = r"(?i)\bvacant\b"
INVESTMENT = r"(?i)investment\s+comp|\bNIY\b|\byield\b|\bcap\s*val"
INVESTMENT_LOOSE = r"(?i)\b(?:NIY|yield|cap(?:ital)?\s*val(?:ue)?)"
AVAILABLE = r"(?i)\bavailable(?:\s+now)?\b"
IMAGE = r"(?i)\.(jpg|jpeg|png|gif|bmp|webp|tiff|ico)$"
JUNK_IMAGE = r"(?i)^(image\d*|photo\d*|pic\d*|logo|stamp|seal|banner|footer|header|signature|icon|spacer|pixel|tracking|~WRD\d*|Slide\d*)\."
DOCUMENTS = r"(?i)\.(pdf|xlsx|xls)$"
STUB_WORDS = ["comps", "comparables", "comp", "market evidence", "rent review", "dilapidations", "service charge", "schedule of condition"]
MODEL_WORDS = ["model", "appraisal", "cashflow", "cash flow", "cash_flow", "underwriting", "proforma", "pro forma", "pro-forma", "forecast", "budget", "valuation", "sensitivity", "irr analysis", "dcf"]
SETTLEMENTS = ["City", "Town", "Suburban Area", "Village", "Hamlet", "Other Settlement", "Section of Named Road"]
LEGAL_FORMS = ["ltd", "limited", "plc", "inc", "llp", "llc"]
STOP_WORDS = (
    "the a an and of at in on for site park estate industrial trading business investment fund intro introduction portfolio centre center works unit units road street lane way drive close ltd limited plc son sons "
    "rd st ave ct pl sq north south east west"
).split()
SMALL_IMAGE, RENT = 51_200, 0.005

WS = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(sub(x, f"^[{WS}]+"), f"[{WS}]+$")


def blank(x: str) -> str:
    return f"({x} is null or {strip(x)} = '')"


def squeeze(x: str) -> str:
    return strip(sub(x, f"[{WS}]+", " "))


def name_key(x: str) -> str:
    return squeeze(sub(f"lower({x})", rf"[^\p{{L}}\p{{N}}\p{{M}}_{WS}]", " "))


def words(x: str) -> str:
    return f"list_filter(string_split({name_key(x)}, ' '), lambda w: w <> '')"


def has(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, {q(pattern)}), false)"


def get(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def day(y: str, m: str, d: str) -> str:
    return f"strftime(try_cast(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') as date), '%Y-%m-%d')"


def close(a: str, b: str, tolerance: float) -> str:
    return f"coalesce({a} > 0 and {b} > 0 and abs({a} - {b}) / nullif(({a} + {b}) / 2, 0) <= {tolerance}, false)"


def iso_date(x: str) -> str:
    from parcelforge.functions.flexdate import MONTHS

    s = strip(x)
    dmy, my, mon, quarter = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", r"^(\d{1,2})[/-](\d{4})$", r"^([A-Za-z]+)\s+(\d{4})$", r"^[Qq]([1-4])\s*[/-]?\s*(\d{4})$"
    months = " ".join(f"when lower({get(s, mon, 1)}) in ({q(m)}, {q(m[:3])}) then '{i + 1}'" for i, m in enumerate(MONTHS))
    month = f"(case {months} end)"
    return f"""case when {blank(x)} then null when {has(s, r'^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} then {s}
        when {has(s, dmy)} then coalesce({day(get(s, dmy, 3), get(s, dmy, 2), get(s, dmy, 1))}, {s})
        when {has(s, my)} then coalesce({day(get(s, my, 2), get(s, my, 1), "'1'")}, {s})
        when {has(s, mon)} and {month} is not null then {day(get(s, mon, 2), month, "'1'")}
        when {has(s, quarter)} then {day(get(s, quarter, 2), f"cast(try_cast({get(s, quarter, 1)} as int) * 3 - 2 as varchar)", "'1'")}
        when {has(s, r'^[0-9]{4}$')} then {s} || '-01-01' else {s} end"""


def quarter_text(x: str, checked: bool) -> str:
    s = strip(x)
    new, old, dmy, my = r"^(\d{4})\s*[Qq]([1-4])$", r"^[Qq]([1-4])\s*[-/]?\s*(\d{4})$", r"^\s*\d*[^/]*/\s*(\d+)\s*/\s*(\d+)\s*$", r"^\s*(\d+)\s*/\s*(\d+)\s*$"
    month = f"try_cast(case when {has(s, dmy)} then {get(s, dmy, 1)} when {has(s, my)} then {get(s, my, 1)} end as int)"
    year = f"try_cast(case when {has(s, dmy)} then {get(s, dmy, 2)} when {has(s, my)} then {get(s, my, 2)} end as int)"
    ok = f"{month} between 1 and 12 and {year} between 2000 and 2100" if checked else "true"
    return f"""case when {has(s, new)} then {get(s, new, 1)} || ' Q' || {get(s, new, 2)} when {has(s, old)} then {get(s, old, 2)} || ' Q' || {get(s, old, 1)}
        when {ok} then cast({year} as varchar) || ' Q' || cast(cast(floor(({month} - 1) / 3.0) + 1 as int) as varchar) end"""


POSTCODE = r"(?i)[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}"


def spaced(x: str) -> str:
    return f"(case when length({x}) > 3 then left({x}, length({x}) - 3) || ' ' || right({x}, 3) else {x} end)"


def tidy_postcode(x: str) -> str:
    s = "upper(" + sub(x, f"[{WS}]") + ")"
    return f"(case when {has(s, '(?i)^[A-Z]{1,2}[0-9][A-Z0-9]?[ ]*[0-9][A-Z]{2}')} then {spaced(s)} else upper({strip(x)}) end)"


def total_address(a: str, t: str, p: str) -> str:
    a, t, p = (f"coalesce({strip(c)}, '')" for c in (a, t, p))
    keep = lambda c: f"case when {c} <> '' and not contains(lower({a}), lower({c})) then {c} end"
    return f"concat_ws(', ', case when {a} <> '' then {a} end, {keep(t)}, {keep(p)})"


def cut_postcode(x: str) -> str:
    s = strip(x)
    head, tail = get(s, rf"(?s)^(.*?){POSTCODE[4:]}".replace("(?s)", "(?is)"), 1), get(s, rf"(?is)^.*?{POSTCODE[4:]}(.*)$", 1)
    return f"(case when {has(s, POSTCODE)} then {strip(sub(strip(sub(head, '[, ]+$') + ' || ' + tail), ',+$'))} else {s} end)"


def acres(x: str) -> str:
    n = get(x, r"(?i)(\d+(?:[.,]\d+)?)\s*(?:-?\s*)?(?:acres?|ac)\b", 1)
    v = f"try_cast(replace({n}, ',', '.') as double)"
    return f"(case when {v} > 0 then round({v} * 43560, 0) end)"


def place_like(x: str) -> str:
    return f"(length({x}) >= 3 and {has(x, r'^\p{L}')} and not {has(x, '[0-9]')} and not {has(x, POSTCODE)})"


DATES = ["lease_start", "lease_expiry", "break_date", "rent_review_date", "comp_date"]


def cleaned_occupational(as_of: str) -> str:
    """The rules of the occupational cleaner one after the other, as common table expressions; ``z`` has all rows."""
    parts = "string_split(source_deal, ',')"
    read = ", ".join(f"{iso_date(c)} as i_{c}" for c in DATES)
    changed = " + ".join(f"(case when i_{c} <> {c} then 1 else 0 end)" for c in DATES)
    kept = ", ".join(f"case when {strip(c)} <> '' then coalesce(i_{c}, {c}) end as {c}" for c in DATES)
    none = f"({blank('address')} and {blank('town')} and {blank('postcode')} and deal <> '')"
    lone = f"({blank('town')} and {blank('postcode')} and t is not null)"
    fill = lambda c, v: f"coalesce({c}, {v}) as {c}, changes + (case when {c} is null and {v} is not null then 1 else 0 end) as changes"
    pa = "(case when size_sqft <> 0 and rent_psf <> 0 then round(rent_psf * size_sqft, 2) end)"
    psf = "(case when rent_pa <> 0 and size_sqft <> 0 then round(rent_pa / size_sqft, 2) + 0.0 end)"
    size = "(case when rent_pa <> 0 and rent_psf <> 0 then round(rent_pa / rent_psf, 0) + 0.0 end)"
    later = f"(case when lease_term_years > 5 and {blank('rent_review_date')} and start + interval 60 month <= date '{as_of}' then start + interval 60 month else start end)"
    dated = "((comp_date is null or comp_date = '') and start is not null)"
    return f"""with a as (select *, {read} from raw_occupational_comps),
    b as (select * exclude ({', '.join(f'i_{c}' for c in DATES)}) replace ({kept}), {changed} as changes, coalesce({strip('source_deal')}, '') as deal from a),
    p as (select id, i as pos, {strip(parts + '[i]')} as part from raw_occupational_comps, range(1, 20) r(i) where i <= len({parts}) and len({parts}) > 1),
    n as (select lower(candidate) as part, min(name) as t from place_dim where local_type in ({', '.join(q(x) for x in SETTLEMENTS)}) group by 1),
    f as (select id, min(pos) as pos, arg_min(t, pos) as t from (select p.id, p.pos, n.t from p join n on lower(p.part) = n.part where {place_like('p.part')}) group by 1),
    rest as (select p.id, string_agg(p.part, ', ' order by p.pos) filter (where p.pos <> f.pos) as rest from p join f using (id) group by 1),
    c0 as (select b.*, f.pos, f.t, coalesce(rest.rest, '') as rest from b left join f using (id) left join rest using (id)),
    c as (select * exclude (pos, t, rest, deal) replace (changes + (case when {none} then (case when pos is not null then 2 else 1 end) when {lone} then 1 else 0 end) as changes,
        case when {none} then (case when pos is not null then rest else deal end) else address end as address, case when {lone} then t else town end as town) from c0),
    d as (select *, case when {blank('postcode')} and not {blank('address')} then nullif({get('address', POSTCODE)}, '') end as found from c),
    e as (select * exclude (found) replace (changes + (case when found is not null then 1 else 0 end) as changes, case when found is not null then {cut_postcode('address')} else address end as address,
        case when found is not null then {tidy_postcode('found')} when not {blank('postcode')} then {tidy_postcode('postcode')} else postcode end as postcode) from d),
    g as (select e.*, k.place_town from e left join (select upper(outcode) as outcode, min(name) as place_town from place_dim group by 1) k on k.outcode = regexp_extract(e.postcode, '^([A-Z]{{1,2}}[0-9][A-Z0-9]?) [0-9][A-Z]{{2}}$', 1)),
    h as (select * exclude (place_town) replace (changes + (case when {blank('town')} and place_town is not null then 1 else 0 end) as changes, case when {blank('town')} and place_town is not null then place_town else town end as town) from g),
    i as (select * replace ({fill('size_sqft', acres('notes'))}) from h), j as (select * replace ({fill('rent_pa', pa)}) from i), l as (select * replace ({fill('rent_psf', psf)}) from j), m as (select * replace ({fill('size_sqft', size)}) from l),
    s as (select *, try_cast(nullif(regexp_extract(lease_start, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') as date) as start from m),
    u as (select * exclude (start) replace (changes + (case when {dated} then 1 else 0 end) as changes, case when {dated} then strftime({later}, '%Y-%m-%d') else comp_date end as comp_date) from s),
    z as (select *, {total_address('address', 'town', 'postcode')} as total_address, {has('notes', INVESTMENT_LOOSE)} as inv, ({has('comp_date', AVAILABLE)} or {has('notes', AVAILABLE)}) as av from u)"""


LETTINGS_ONLY = " select * exclude (inv, av) from z where size_sqft is not null and not inv and not av"
FILTER_COUNTS = """ select count(*) as rows_scanned, cast(sum(changes) as bigint) as cells_filled, count(*) filter (where size_sqft is null) as no_size, count(*) filter (where size_sqft is not null and inv) as investment,
    count(*) filter (where size_sqft is not null and not inv and av) as available, count(*) filter (where size_sqft is not null and not inv and not av) as rows_left from z"""

"""What every query must give, as SQL for DuckDB over the raw test tables."""

from __future__ import annotations

from checks.registry import AREA_LABEL, COUNTRY_LABEL, DISTRICT, DRAWN_AREA, PROVINCE, SETTLEMENT
from checks.views import VIEWS

# Fixed values, stated here once more so that the SQL does not lean on the library.
BANDS = {
    "very_low": ("Very Low", "{v} >= 1 and {v} < 2"),
    "low": ("Low", "{v} >= 2 and {v} < 4"),
    "moderate": ("Moderate", "{v} >= 4 and {v} < 5"),
    "high": ("High", "{v} >= 5 and {v} < 7"),
    "very_high": ("Very High", "{v} >= 7"),
}
PANEL_BANDS = ("low", "moderate", "high", "very_high")
INDEXES = {
    "lsi_immap": (
        "Landslide Indexes (iMMAP 2017)",
        "Population by Landslide Indexes (iMMAP 2017)",
        "Landslide Indexes (iMMAP 2017)",
    ),
    "lsi_ku": (
        "Multi-criteria Susceptibility Index",
        "Population by Multi-criteria Landslide Susceptibility Index",
        "Multi-criteria Landslide Susceptibility Index*",
    ),
    "ls_s1_wb": (
        "Landslide Susceptibility (S1)",
        "Population by Landslide susceptibility - bedrock landslides in slow evolution (S1)",
        "Landslide susceptibility - bedrock landslides in slow evolution (S1)**",
    ),
    "ls_s2_wb": (
        "Landslide Susceptibility (S2)",
        "Population by Landslide susceptibility - bedrock landslides in rapid evolution (S2)",
        "Landslide susceptibility - bedrock landslides in rapid evolution (S2)**",
    ),
    "ls_s3_wb": (
        "Landslide Susceptibility (S3)",
        "Population by Landslide susceptibility - cover material in rapid evolution (S3)",
        "Landslide susceptibility - cover material in rapid evolution (S3)**",
    ),
}
CELLS = [f"{i}_{b}" for i in INDEXES for b in BANDS]
PANEL_CELLS = [f"{i}_{b}" for i in INDEXES for b in PANEL_BANDS]

SUMS = ",\n".join(
    f"coalesce(round(sum(case when {condition.format(v=i)} then vuid_population end)), 0) as {i}_{b}"
    for i in INDEXES
    for b, (_, condition) in BANDS.items()
)

JOINED = """
select h.prov_code as h_prov, h.dist_code as h_dist, lsi_immap, lsi_ku, ls_s1_wb, ls_s2_wb, ls_s3_wb, p.*
from hazard h join settlement p on h.vuid = p.vuid
"""

LEVELS = f"""
select 'country' as scope_level, cast(null as varchar) as code, {SUMS} from joined
union all select 'province', prov_code_1, {SUMS} from joined group by prov_code_1
union all select 'district', dist_code, {SUMS} from joined group by dist_code
"""

PROVINCES = f"select h_prov as code, prov_na_en as na_en, {SUMS} from joined group by 1, 2"
DISTRICTS = f"select prov_code_1 as parent, h_dist as code, dist_na_en as na_en, {SUMS} from joined group by 1, 2, 3"

EDGES = r"""
with parts as (
  select aoi_id, ord, generate_subscripts(p, 1) - 1 as part, unnest(p) as txt
  from (select aoi_id, ord, string_split_regex(wkt, '\)\s*\)\s*,\s*\(\s*\(') as p from aoi)
), rings as (
  select aoi_id, ord, part, generate_subscripts(r, 1) - 1 as ring, unnest(r) as txt
  from (select aoi_id, ord, part, string_split_regex(txt, '\)\s*,\s*\(') as r from parts)
), points as (
  select aoi_id, ord, part, ring, generate_subscripts(p, 1) - 1 as pos, trim(unnest(p)) as txt
  from (select aoi_id, ord, part, ring, string_split(regexp_replace(txt, '[A-Z()]', '', 'g'), ',') as p from rings)
), coordinates as (
  select aoi_id, ord, part, ring, pos,
         cast(split_part(txt, ' ', 1) as double) as x, cast(split_part(txt, ' ', 2) as double) as y
  from points
), pairs as (
  select aoi_id, ord, part, ring, pos, x as x1, y as y1,
         lead(x) over w as x2, lead(y) over w as y2
  from coordinates window w as (partition by aoi_id, ord, part, ring order by pos)
)
select aoi_id, ord, cast(part as int) as part, cast(ring as int) as ring, cast(pos as int) as pos, x1, y1, x2, y2
from pairs where x2 is not null
"""

# Every settlement against every edge. The side of an edge is told by the sign of a product, not by
# a division: a settlement at (72.85, 35.05) shows that the division rounds to the wrong side.
INSIDE = """
select distinct aoi_id, vuid from (
  select aoi_id, ord, part, vuid,
         bool_or(lon between least(x1, x2) and greatest(x1, x2) and lat between least(y1, y2) and greatest(y1, y2)
                 and turn = 0) as on_edge,
         sum(case when (y1 > lat) <> (y2 > lat) and (turn > 0) = (y2 > y1) then 1 else 0 end) as hits
  from (select *, (x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1) as turn from edges, settlement)
  group by aoi_id, ord, part, vuid
) where on_edge or hits % 2 = 1
"""

AREAS = f"""
select a.aoi_id, {", ".join(f"coalesce(s.{c}, 0) as {c}" for c in CELLS)}
from (select distinct aoi_id from aoi) a left join (
  select i.aoi_id, {SUMS} from inside i join joined j on i.vuid = j.vuid group by i.aoi_id
) s on a.aoi_id = s.aoi_id
"""

AREA_BASE = """
select a.aoi_id, coalesce(s.pop_total, 0) as pop_total
from (select distinct aoi_id from aoi union select 99) a left join (
  select i.aoi_id, sum(p.vuid_population) as pop_total
  from inside i join settlement p on i.vuid = p.vuid group by i.aoi_id
) s on a.aoi_id = s.aoi_id
"""

SHAPE_EDGES = EDGES.replace("aoi_id", "vuid").replace("from aoi)", "from shape)")
LAND_EDGES = EDGES.replace("aoi_id", "land_id").replace("from aoi)", "from land)")
BLOCK_EDGES = EDGES.replace("from aoi)", "from block_area)")


def _whole(source: str, ids: str) -> str:
    """Edges in whole numbers of 1e-5 degrees."""
    ends = ", ".join(f"cast(round({c} * 100000) as bigint) as {c}" for c in ("x1", "y1", "x2", "y2"))
    return f"select {ids}, ring, pos, {ends} from {source}"


def _holds(polygons: str, points: str) -> str:
    """Polygons that hold the first corner of a ring, by the even-odd rule."""
    return f"""
select distinct aoi_id, vuid from (
  select a.aoi_id, s.vuid, a.ord as ord, a.part as part, s.part as part2, {points}.ring as ring,
         count_if(({polygons}.y1 > {points}.y1) <> ({polygons}.y2 > {points}.y1)
           and (({polygons}.x2 - {polygons}.x1) * ({points}.y1 - {polygons}.y1)
                - ({points}.x1 - {polygons}.x1) * ({polygons}.y2 - {polygons}.y1) > 0) = ({polygons}.y2 > {polygons}.y1)) as hits
  from area_whole a, shape_whole s where {points}.pos = 0
  group by all
) where hits % 2 = 1"""


# Every edge of a shape against every edge of an area, and a corner of each ring of one against the other.
MEETING = f"""
select distinct a.aoi_id, s.vuid from area_whole a, shape_whole s
where least(a.x1, a.x2) <= greatest(s.x1, s.x2) and least(s.x1, s.x2) <= greatest(a.x1, a.x2)
  and least(a.y1, a.y2) <= greatest(s.y1, s.y2) and least(s.y1, s.y2) <= greatest(a.y1, a.y2)
  and sign((a.x2 - a.x1) * (s.y1 - a.y1) - (s.x1 - a.x1) * (a.y2 - a.y1))
    * sign((a.x2 - a.x1) * (s.y2 - a.y1) - (s.x2 - a.x1) * (a.y2 - a.y1)) <= 0
  and sign((s.x2 - s.x1) * (a.y1 - s.y1) - (a.x1 - s.x1) * (s.y2 - s.y1))
    * sign((s.x2 - s.x1) * (a.y2 - s.y1) - (a.x2 - s.x1) * (s.y2 - s.y1)) <= 0
union {_holds("a", "s")}
union {_holds("s", "a")}
"""

# What two polygons share is the sum over pairs of their edges of the area below both, signed by the edges' ways: these
# areas' outer rings run to the left, as their holes do, which count less. The lower of two lines is half of what
# their sum is above their difference.
_BELOW = """
select {ids}, sum({sign} * (b - a) / 2 * ((ea + eb + fa + fb) / 2 - case
    when (ea - fa) * (eb - fb) >= 0 then (abs(ea - fa) + abs(eb - fb)) / 2
    else ((ea - fa) * (ea - fa) + (eb - fb) * (eb - fb)) / (abs(ea - fa) + abs(eb - fb)) / 2 end)) as surface
from (
  select *, ey1 + (ey2 - ey1) * (a - ex1) / (ex2 - ex1) as ea, ey1 + (ey2 - ey1) * (b - ex1) / (ex2 - ex1) as eb,
         fy1 + (fy2 - fy1) * (a - fx1) / (fx2 - fx1) as fa, fy1 + (fy2 - fy1) * (b - fx1) / (fx2 - fx1) as fb
  from (
    select {ids}, e.ring as ering, f.ring as fring,
           greatest(least(e.x1, e.x2), least(f.x1, f.x2)) as a, least(greatest(e.x1, e.x2), greatest(f.x1, f.x2)) as b,
           e.x1 as ex1, e.x2 as ex2, e.y1 - 29 as ey1, e.y2 - 29 as ey2,
           f.x1 as fx1, f.x2 as fx2, f.y1 - 29 as fy1, f.y2 - 29 as fy2
    from land_edges e join {other} f on {on} e.x1 <> e.x2 and f.x1 <> f.x2
      and least(e.x1, e.x2) < greatest(f.x1, f.x2) and least(f.x1, f.x2) < greatest(e.x1, e.x2)
  )
) group by {group}
"""
_SIGN = "(case when (ex2 > ex1) = (fx2 > fx1) then 1 else -1 end) * (case when (ering = 0) = (fring = 0) then 1 else -1 end)"
SHARED = _BELOW.format(ids="e.land_id, f.aoi_id", group="land_id, aoi_id", sign=_SIGN, other="block_edges", on="").replace(
    "select e.land_id, f.aoi_id, sum", "select land_id, aoi_id, sum"
)
OWN = _BELOW.format(
    ids="e.land_id", group="land_id", sign=_SIGN, other="land_edges", on="e.land_id = f.land_id and"
).replace("select e.land_id, sum", "select land_id, sum")
LAND_SHARE = """
select s.land_id, s.aoi_id, least(1, s.surface / o.surface) as share
from shared s join own o using (land_id) where s.surface > 1e-9
"""

DERIVED = {
    "joined": (JOINED, ("hazard", "settlement")),
    "levels": (LEVELS, ("joined",)),
    "provinces": (PROVINCES, ("joined",)),
    "districts": (DISTRICTS, ("joined",)),
    "edges": (EDGES, ("aoi",)),
    "shape_edges": (SHAPE_EDGES, ("shape",)),
    "area_whole": (_whole("edges", "aoi_id, ord, part"), ("edges",)),
    "shape_whole": (_whole("shape_edges", "vuid, ord, part"), ("shape_edges",)),
    "meeting": (MEETING, ("area_whole", "shape_whole")),
    "land_edges": (LAND_EDGES, ("land",)),
    "block_edges": (BLOCK_EDGES, ("block_area",)),
    "shared": (SHARED, ("land_edges", "block_edges")),
    "own": (OWN, ("land_edges",)),
    "land_share": (LAND_SHARE, ("shared", "own")),
    "inside": (INSIDE, ("edges", "settlement")),
    "areas": (AREAS, ("aoi", "inside", "joined")),
    "area_base": (AREA_BASE, ("aoi", "inside", "settlement")),
    "area_based": (
        "select 'area' as scope_level, cast(b.aoi_id as varchar) as code, b.pop_total, "
        + ", ".join(f"coalesce(a.{c}, 0) as {c}" for c in CELLS)
        + " from area_base b left join areas a using (aoi_id)",
        ("area_base", "areas"),
    ),
    "last_district": (
        "select * from districts qualify row_number() over (partition by code order by na_en desc nulls first) = 1",
        ("districts",),
    ),
    "last_province": (
        "select * from provinces qualify row_number() over (partition by code order by na_en desc nulls first) = 1",
        ("provinces",),
    ),
    "based": (
        "select l.*, b.pop_total from levels l left join baseline b"
        " on l.scope_level = b.scope_level and l.code is not distinct from b.code",
        ("levels", "baseline"),
    ),
}


def _with(body: str, *needs: str) -> str:
    """``body`` after the definitions it needs, each once."""
    order: list[str] = []

    def visit(name: str) -> None:
        sql, below = (VIEWS | DERIVED).get(name, (None, ()))
        for n in below:
            visit(n)
        if sql is not None and name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    ctes = []
    for name in order:
        if name in VIEWS:
            sql, below = VIEWS[name]
            sql = sql.format(**{n: n for n in below})
        else:
            sql = DERIVED[name][0]
        ctes.append(f"{name} as ({sql})")
    return "with " + ",\n".join(ctes) + "\n" + body


def _label(value: str) -> str:
    ladder = " ".join(f"when {condition.format(v=value)} then '{label}'" for label, condition in BANDS.values())
    return f"case {ladder} else 'None' end"


def _at_risk(index: str, prefix: str = "") -> str:
    return "(" + " + ".join(f"{prefix}{index}_{b}" for b in PANEL_BANDS) + ")"


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def _indexed(template: str) -> list[str]:
    """The template once per index, with ``{n} {i} {title} {table} {record}`` filled in."""
    return [
        template.format(n=n, i=i, title=title, table=table, record=record, risk=_at_risk(i))
        for n, (i, (title, table, record)) in enumerate(INDEXES.items(), start=1)
    ]


SUMMARY = _union(
    _indexed(
        "select scope_level, code, {n} as index_pos, '{i}' as index_key, '{title}' as title,"
        " {risk} as total_atrisk, pop_total as total from based"
    )
)
NOT_AT_RISK = _union(
    _indexed("select scope_level, code, '{i}' as index_key, pop_total - {risk} as not_at_risk from based")
)


def _bars(source: str, ids: str) -> list[str]:
    return [
        f"select {ids} {n} as index_pos, '{i}' as index_key, '{title}' as title, {pos} as pos,"
        f" '{BANDS[b][0]}' as label, {i}_{b} as population from {source}"
        for n, (i, (title, _, _)) in enumerate(INDEXES.items(), start=1)
        for pos, b in enumerate(PANEL_BANDS, start=1)
    ]


def _donuts(source: str, ids: str) -> list[str]:
    return _bars(source, ids) + _indexed(
        f"select {ids} {{n}} as index_pos, '{{i}}' as index_key, '{{title}}' as title, 5 as pos,"
        f" 'Not at Risk' as label, pop_total - {{risk}} as population from {source}"
    )


def _table(source: str, ids: str, is_total: bool, code: str, name: str) -> list[str]:
    return [
        f"select {ids} {n} as index_pos, '{i}' as index_key, '{table}' as title, {str(is_total).lower()} as is_total,"
        f" {code} as child_code, {name} as na_en, " + ", ".join(f"{i}_{b} as {b}" for b in PANEL_BANDS) + f" from {source}"
        for n, (i, (_, table, _)) in enumerate(INDEXES.items(), start=1)
    ]


NO_CODE = "cast(null as varchar)"
NAMES = """(
select prov_code_1 as code, 'province' as scope_level, max(prov_na_en) as name from joined group by 1
union all select dist_code, 'district', max(dist_na_en) from joined group by 1)"""

SCOPE_TABLES = _union(
    _table(
        f"levels left join {NAMES} as k using (scope_level, code)",
        "scope_level, code as scope_code,",
        True,
        NO_CODE,
        f"case scope_level when 'country' then '{COUNTRY_LABEL}' else name end",
    )
    + _table("provinces", f"'country' as scope_level, {NO_CODE} as scope_code,", False, "code", "na_en")
    + _table("districts", "'province' as scope_level, parent as scope_code,", False, "code", "na_en")
)

AREA_TABLES = _union(_table("area_based", "scope_level, code as scope_code,", True, NO_CODE, f"'{AREA_LABEL}'"))


def _documents(source: str, tables: str) -> str:
    def text(sql: str) -> str:
        return f"coalesce(cast({sql} as varchar), 'null')"

    parts = []
    for n, (i, (title, table, _)) in enumerate(INDEXES.items(), start=1):
        head = f"""'{{"key":"{i}","title":"{title}",'"""
        slices = [f"""'{{"label":"{BANDS[b][0]}","value":' || {text(f"{i}_{b}")} || '}}'""" for b in PANEL_BANDS]
        rest = f"pop_total - {_at_risk(i)}"
        slices.append(f"""'{{"label":"Not at Risk","value":' || {text(rest)} || '}}'""")
        donut = head + """ || '"child":[' || """ + " || ',' || ".join(slices) + " || ']}'"
        labels = ",".join(f'"{BANDS[b][0]}"' for b in PANEL_BANDS)
        values = " || ',' || ".join(text(f"{i}_{b}") for b in PANEL_BANDS)
        bar = head + f""" || '"labels":[{labels}],"values":[' || {values} || ']}}'"""
        for panel, document in (("donut", donut), ("bar", bar)):
            parts.append(
                f"select scope_level, code as scope_code, '{panel}' as panel, {n} as index_pos, '{i}' as index_key,"
                f" false as is_total, {NO_CODE} as child_code, cast(null as int) as position, {document} as doc from {source}"
            )
    values = " || ',' || ".join(text(b) for b in PANEL_BANDS)
    parts.append(
        "select scope_level, scope_code, 'table' as panel, index_pos, index_key, is_total, child_code,"
        " cast(row_number() over (partition by scope_level, scope_code, index_pos"
        " order by is_total desc, na_en nulls last, child_code nulls last) as int) as position,"
        """ '{"key":"' || index_key || '","title":"' || title || '","name":' || coalesce('"' || na_en || '"', 'null')"""
        f""" || ',"values":[' || {values} || ']}}' as doc from {tables}"""
    )
    return _union(parts)


def _named_cells(prefix: str, cells: list[str]) -> str:
    return ", ".join(f"{prefix}{c} as {c}" for c in cells)


_PROFILE_FIELDS = """p.vuid, name_en, dist_na_en, prov_na_en,
 coalesce(area_sqm, 0) as area_sqm, coalesce(area_population, 0) as area_population,
 coalesce(vuid_population, 0) as vuid_population, coalesce(vuid_buildings, 0) as vuid_buildings,
 format('{:,.1f}', coalesce(area_sqm, 0) / 1000000) || ' km2' as area_text,
 format('{:,}', cast(round(coalesce(area_population, 0)) as bigint)) as area_population_text,
 format('{:,}', cast(round(coalesce(vuid_population, 0)) as bigint)) as vuid_population_text,
 format('{:,}', coalesce(vuid_buildings, 0)) as vuid_buildings_text,
"""
PROFILE = (
    "select "
    + _PROFILE_FIELDS
    + ", ".join(f"{_label(i)} as {i}_class" for i in INDEXES)
    + " from hazard h join settlement p on h.vuid = p.vuid"
)

MATRIX = _union(
    [
        f"select vuid, {n} as index_pos, '{i}' as index_key, '{record}' as title,"
        f" case when {_label(i)} = 'None' then 'X' else '' end as no_risk, "
        + ", ".join(f"case when {condition.format(v=i)} then 'X' else '' end as {b}" for b, (_, condition) in BANDS.items())
        + " from hazard"
        for n, (i, (_, _, record)) in enumerate(INDEXES.items(), start=1)
    ]
)



def _matrix_row(index: str, record: str) -> str:
    labels = {"no_risk": "None"} | {b: label for b, (label, _) in BANDS.items()}
    marks = " || ',' || ".join(
        f"""'"{key}":"' || case when {index}_class = '{label}' then 'X' else '' end || '"'""" for key, label in labels.items()
    )
    return f"""'{{"key":"{index}","title":"{record}",' || {marks} || '}}'"""


_TEXTS = ("name_en", "dist_na_en", "prov_na_en", "area_text", "area_population_text", "vuid_population_text", "vuid_buildings_text")
DOCUMENTS = (
    "select vuid, '{' || "
    + " || ',' || ".join(f"""'"{c}":' || coalesce('"' || {c} || '"', 'null')""" for c in _TEXTS)
    + """ || ',"matrix":[' || """
    + " || ',' || ".join(_matrix_row(i, record) for i, (_, _, record) in INDEXES.items())
    + f" || ']}}' as doc from ({PROFILE})"
)

LONG = _union(
    [
        f"select scope_level, code, {n} as index_pos, '{i}' as index_key, {pos} as band_pos, '{b}' as band_key,"
        f" '{label}' as band_label, '{i}_{b}' as cell_key, {i}_{b} as population from levels"
        for n, i in enumerate(INDEXES, start=1)
        for pos, (b, (label, _)) in enumerate(BANDS.items(), start=1)
    ]
)

_ROUTE = """case when flag = 'entireAfg' then 'country' when flag = 'currentProvince' and length(code) > 2 then 'district'
 when flag = 'currentProvince' then 'province' else 'area' end"""
SCOPE_BATCH = f"""
select r.req_id, r.scope_level, r.flag, r.code, {", ".join(f"coalesce(l.{c}, a.{c}, 0) as {c}" for c in CELLS)}
from (select *, {_ROUTE} as scope_level from scope_request) r
left join levels l on l.scope_level = r.scope_level and (r.scope_level = 'country' or l.code = r.code)
left join areas a on r.scope_level = 'area' and a.aoi_id = r.aoi_id
"""
SCOPE_CHILDREN = f"""
select req_id, 'province' as child_level, p.code, na_en, {_named_cells("p.", CELLS)}
from scope_request r join provinces p on r.flag = 'entireAfg'
union all
select req_id, 'district', d.code, na_en, {_named_cells("d.", CELLS)}
from scope_request r join districts d on r.flag = 'currentProvince' and length(r.code) = 2 and d.parent = r.code
"""

BOUNDARY_CHILDREN = f"""
select b.code, b.shape_name, l.na_en, case when l.code is not null then 0.0::double end as value,
       {_named_cells("l.", PANEL_CELLS)}, case when l.code is not null then 7 end as set_jenk_divider
from boundary b left join last_province l on b.code = l.code
"""
BOUNDARY_DISTRICTS = BOUNDARY_CHILDREN.replace("last_province", "last_district").replace("boundary b", "district_boundary b")
BOUNDARY_PARENT = f"""
select b.code, b.shape_name, '{DISTRICT}' as na_en, 0.0::double as value, {_named_cells("t.", PANEL_CELLS)},
       1 as set_jenk_divider
from boundary b cross join (select {SUMS} from joined where dist_code = '{DISTRICT}') t
"""

_COUNTRY = "(select * from based where scope_level = 'country')"
OVERVIEW = _union(
    _donuts(_COUNTRY, "'donut' as panel,")
    + _bars(_COUNTRY, "'bar' as panel,")
    + [
        f"select 'table' as panel, {n} as index_pos, '{i}' as index_key, '{table}' as title, {pos} as pos,"
        f" '{BANDS[b][0]}' as label, {i}_{b} as population from {_COUNTRY}"
        for n, (i, (_, table, _)) in enumerate(INDEXES.items(), start=1)
        for pos, b in enumerate(PANEL_BANDS, start=1)
    ]
)

ORACLE = {
    "exposure_national": _with(f"select {SUMS} from joined", "joined"),
    "exposure_province": _with(f"select {SUMS} from joined where prov_code_1 = '{PROVINCE}'", "joined"),
    "exposure_district": _with(f"select {SUMS} from joined where dist_code = '{DISTRICT}'", "joined"),
    "exposure_by_province": _with("select * from provinces order by na_en nulls last", "provinces"),
    "exposure_by_district": _with(
        f"select * exclude (parent) from districts where parent = '{PROVINCE}' order by na_en nulls last", "districts"
    ),
    "exposure_all_levels": _with("select * from levels", "levels"),
    "exposure_long": _with(LONG, "levels"),
    "exposure_scope_batch": _with(SCOPE_BATCH, "scope_request", "levels", "areas"),
    "exposure_scope_children": _with(SCOPE_CHILDREN, "scope_request", "provinces", "districts"),
    "baseline_population": _with("select * from baseline", "baseline"),
    "at_risk_summary": _with(SUMMARY, "based"),
    "not_at_risk": _with(NOT_AT_RISK, "based"),
    "bar_series": _with(_union(_bars("levels", "scope_level, code,")), "levels"),
    "donut_series": _with(_union(_donuts("based", "scope_level, code,")), "based"),
    "table_with_total": _with(
        _union(
            _table("levels where scope_level = 'country'", "", True, NO_CODE, f"'{COUNTRY_LABEL}'")
            + _table("provinces", "", False, "code", "na_en")
        ),
        "levels",
        "provinces",
    ),
    "scope_tables": _with(SCOPE_TABLES, "levels", "provinces", "districts"),
    "panel_list": _with(
        f"select * from (with tables as ({SCOPE_TABLES}) {_documents('based', 'tables')})", "based", "provinces", "districts"
    ),
    "quick_overview": _with(OVERVIEW, "based"),
    "child_last_wins": _with("select * from last_province", "last_province"),
    "boundary_children": _with(BOUNDARY_CHILDREN, "boundary", "last_province"),
    "boundary_geojson": _with(BOUNDARY_CHILDREN, "boundary", "last_province"),
    "boundary_district_children": _with(BOUNDARY_DISTRICTS, "district_boundary", "last_district"),
    "boundary_parent": _with(BOUNDARY_PARENT, "boundary", "joined"),
    "susceptibility_class": _with(
        "select vuid, " + ", ".join(f"{_label(i)} as {i}_class" for i in INDEXES) + " from hazard", "hazard"
    ),
    "susceptibility_matrix": _with(MATRIX, "hazard"),
    "settlement_profile": _with(PROFILE, "hazard"),
    "settlement_documents": _with(DOCUMENTS, "hazard"),
    "settlement_record": _with(f"{PROFILE} where p.vuid = {SETTLEMENT}", "hazard"),
    "aoi_edges": _with("select * from edges", "edges"),
    "aoi_settlements": _with("select aoi_id, vuid from inside", "inside"),
    "aoi_settlement_shapes": _with("select aoi_id, vuid from meeting", "meeting"),
    "exposure_aoi_shapes": _with(
        f"""select a.aoi_id, {", ".join(f"coalesce(s.{c}, 0) as {c}" for c in CELLS)}
from (select distinct aoi_id from aoi) a left join (
  select m.aoi_id, {SUMS} from meeting m join joined j on m.vuid = j.vuid group by m.aoi_id
) s on a.aoi_id = s.aoi_id""",
        "aoi",
        "meeting",
        "joined",
    ),
    "baseline_land_cover": _with(
        _union(
            [
                f"select '{level}' as scope_level, {code} as code, kind, round(sum(area_population)) as pop_total, "
                f"cast(sum(area_buildings) as double) as building_total from land group by {code}, kind"
                for level, code in (
                    ("country", "cast(null as varchar)"), ("province", "prov_code"), ("district", "dist_code")
                )
            ]
            + [
                "select 'area', cast(aoi_id as varchar), kind, round(sum(area_population * share)), "
                "round(sum(area_buildings * share)) from land_share join land using (land_id) group by 2, 3"
            ]
        ),
        "land",
        "land_share",
    ),
    "aoi_union_settlements": _with("select distinct vuid from inside", "inside"),
    "exposure_aoi": _with(
        f"select {SUMS} from joined where vuid in (select vuid from inside where aoi_id = {DRAWN_AREA})",
        "joined",
        "inside",
    ),
    "exposure_aoi_batch": _with("select * from areas", "areas"),
    "baseline_aoi": _with("select * from area_base where aoi_id <> 99", "area_base"),
    "aoi_panel_list": _with(
        f"select * from (with tables as ({AREA_TABLES}) {_documents('area_based', 'tables')})", "area_based"
    ),
}
ORACLE |= {
    "exposure_aoi_by_place": ORACLE["exposure_aoi"],
    "exposure_levels_kept": ORACLE["exposure_all_levels"],
    "exposure_by_province_collated": _with(
        """select code, name as na_en, row_number() over (order by lower(name) nulls last, code nulls last, name) as position, lsi_ku_low
        from (select *, case when code = '07' then lower(na_en) else na_en end as name from provinces)""",
        "provinces",
    ),
}

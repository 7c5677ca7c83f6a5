"""Hazard, settlement and request views derived from the driver's test tables.

The view definitions are plain SQL that means the same to Spark and to DuckDB, so that the
checks can build the same inputs on both sides; ``{name}`` stands for an input table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTLEMENT = """
select o_orderkey as vuid,
       concat('SETTLEMENT_', cast(o_orderkey as string)) as name_en,
       lpad(cast(n_nationkey + 1 as string), 2, '0') as prov_code_1,
       n_name as prov_na_en,
       concat(lpad(cast(n_nationkey + 1 as string), 2, '0'),
              case c_mktsegment when 'AUTOMOBILE' then '01' when 'BUILDING' then '02'
                when 'FURNITURE' then '03' when 'HOUSEHOLD' then '04' else '05' end) as dist_code,
       nullif(concat(n_name, '/', c_mktsegment), 'JAPAN/BUILDING') as dist_na_en,
       cast(cast(floor(o_totalprice) as bigint) % 4000 as double) / 8 as vuid_population,
       cast(cast(floor(o_totalprice) as bigint) % 5000 as double) / 4 as area_population,
       cast(floor(o_totalprice) as bigint) % 300 as vuid_buildings,
       cast((o_orderkey * 3571) % 90000000 as double) as area_sqm,
       60 + cast((o_orderkey * 7919) % 15000 as double) / 1000 as lon,
       29 + cast((o_orderkey * 6007) % 10000 as double) / 1000 as lat
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
"""

HAZARD = """
select vuid,
       case when vuid % 101 = 0 then '01' else prov_code_1 end as prov_code,
       dist_code,
       cast(nullif((vuid * 7919) % 11, 10) as double) as lsi_immap,
       cast((vuid * 31) % 40 as double) / 4 as lsi_ku,
       cast((vuid * 13) % 10 as double) as ls_s1_wb,
       cast((vuid * 17) % 8 as double) as ls_s2_wb,
       cast((vuid * 29) % 3 as double) as ls_s3_wb
from {settlement} where vuid % 17 <> 0
"""

BASELINE = """
select 'country' as scope_level, cast(null as string) as code, sum(vuid_population) as pop_total from {settlement}
union all select 'province', prov_code_1, sum(vuid_population) from {settlement} group by prov_code_1
union all select 'district', dist_code, sum(vuid_population) from {settlement} group by dist_code
"""

BOUNDARY = """
select lpad(cast(n_nationkey + 1 as string), 2, '0') as code, concat('shape_', n_name) as shape_name from {nation}
union all select '99', 'shape_unmatched'
"""

# The hand-made areas (a hole, an overlap, a multipolygon, a repeated polygon), and one request per
# supplier: a block with a hole, for every third one also a triangle that overlaps the block.
AOI = """
select cast(aoi_id as bigint) as aoi_id, ord, wkt from (values
  (1, 0, 'POLYGON((62 30, 66 30, 66 34, 62 34, 62 30),(63 31, 64 31, 64 32, 63 32, 63 31))'),
  (1, 1, 'POLYGON ((65 33,70 33,68 37,65 33))'),
  (2, 0, 'MULTIPOLYGON(((70 29,72 31,70 33,68 31,70 29)),((60.5 29.5,61 29.5,61 30,60.5 29.5)))'),
  (3, 0, 'POLYGON((70 29,72 31,70 33,68 31,70 29))'),
  (3, 1, 'POLYGON((70 29,72 31,70 33,68 31,70 29))'),
  (4, 0, 'MULTIPOLYGON(((62 30,66 30,66 34,62 34,62 30)),((64 32,68 32,68 36,64 36,64 32),(65 35,66 35,66 35.5,65 35)))')
) as t(aoi_id, ord, wkt)
union all
select 1000 + s_suppkey, 0,
       concat('POLYGON((', x0, ' ', y0, ',', x3, ' ', y0, ',', x3, ' ', y3, ',', x0, ' ', y3, ',', x0, ' ', y0,
              '),(', x1, ' ', y1, ',', x2, ' ', y1, ',', x2, ' ', y2, ',', x1, ' ', y2, ',', x1, ' ', y1, '))')
from {block}
union all
select 1000 + s_suppkey, 1,
       concat('POLYGON((', x1, ' ', y1, ', ', x4, ' ', y1, ', ', x3, ' ', y4, ', ', x1, ' ', y1, '))')
from {block} where s_suppkey % 3 = 0
"""

_TENTH = "cast(cast(cast({} as double) / 10 as decimal(9,1)) as string)"
_X = "600 + (s_suppkey * 37) % 140"
_Y = "290 + (s_suppkey * 53) % 90"
BLOCK = "select s_suppkey, " + ", ".join(
    f"{_TENTH.format(f'({origin} + {step})')} as {axis}{n}"
    for axis, origin in (("x", _X), ("y", _Y))
    for n, step in enumerate(("0", "3", "6", "12 + s_suppkey % 5", "20 + s_suppkey % 7"))
) + " from {supplier}"

# The routing rows, then one request per customer (its district or its province) and one per drawn area.
SCOPE_REQUEST = """
select cast(req_id as bigint) as req_id, flag, code, cast(null as bigint) as aoi_id from (values
  (1, 'entireAfg', ''), (2, 'currentProvince', '07'), (3, 'currentProvince', '0703'),
  (4, 'currentProvince', '77'), (5, 'currentProvince', '7')
) as t(req_id, flag, code)
union all
select 1000000 + c_custkey, 'currentProvince',
       case when c_custkey % 2 = 0 then lpad(cast(c_nationkey + 1 as string), 2, '0')
            else concat(lpad(cast(c_nationkey + 1 as string), 2, '0'),
                        lpad(cast(1 + c_custkey % 5 as string), 2, '0')) end,
       cast(null as bigint)
from {customer}
union all
select 500000 + aoi_id, case when aoi_id % 2 = 0 then 'drawArea' else 'otherFlag' end, '', aoi_id
from (select distinct aoi_id from {aoi}) as a
"""

# Request bodies: each area's texts as a list, and one without any.
AOI_REQUEST = """
select aoi_id, array_sort(collect_list(named_struct('ord', ord, 'wkt', wkt))).wkt as spatialfilter,
       'drawArea' as flag, '' as code
from {aoi} group by aoi_id
union all select 99, array(), 'drawArea', ''
"""

DISTRICT_BOUNDARY = """
select distinct dist_code as code, concat('district ', dist_code) as shape_name from {settlement}
union all select '9999', 'district without settlements'
"""



def _corner(x: str, y: str) -> str:
    """A corner of a polygon text, from whole numbers of 1e-5 degrees."""
    return ", ' ', ".join(f"cast(cast(cast({c} as double) / 100000 as decimal(9,5)) as string)" for c in (x, y))


def _ring(*offsets: tuple[int, int], east: str = "") -> str:
    """A ring about the row's place, ``k`` times the offsets."""
    corners = [_corner(f"(x + {dx} * k{east})", f"(y + {dy} * k)") for dx, dy in (*offsets, offsets[0])]
    return "concat('(', " + ", ',', ".join(corners) + ", ')')"


_FOUR = ((0, 0), (210, 42), (280, 210), (-30, 180))
_HOLE = ((60, 60), (150, 70), (120, 150))

# Slanted quadrangles at the settlements' places; large ones with a hole, and some of two polygons.
SHAPE = f"""
select vuid, 0 as ord,
       case when vuid % 40 = 0 then concat('POLYGON(', {_ring(*_FOUR)}, ',', {_ring(*_HOLE)}, ')')
            when vuid % 7 = 0 then concat('MULTIPOLYGON((', {_ring(*_FOUR)}, '),(', {_ring(*_FOUR, east=" + 5000")}, '))')
            else concat('POLYGON(', {_ring(*_FOUR)}, ')') end as wkt
from (select vuid, case when vuid % 40 = 0 then 285 else 3 + vuid % 3 end as k,
             6000037 + ((vuid * 7919) % 15000) * 100 as x, 2900011 + ((vuid * 6007) % 10000) * 100 as y
      from {{settlement}}) as s
"""

# Land cover in the same outline, one polygon per customer.
LAND = f"""
select c_custkey as land_id, 0 as ord, lpad(cast(c_nationkey + 1 as string), 2, '0') as prov_code,
       concat(lpad(cast(c_nationkey + 1 as string), 2, '0'), lpad(cast(1 + c_custkey % 5 as string), 2, '0')) as dist_code,
       c_mktsegment as kind, cast((c_custkey * 37) % 5000 as double) / 7 as area_population,
       cast((c_custkey * 53) % 300 as bigint) as area_buildings,
       concat('POLYGON(', {_ring(*_FOUR)}, ')') as wkt
from (select *, 100 + c_custkey % 90 as k, 6000037 + ((c_custkey * 7919) % 14000) * 100 as x,
             2900011 + ((c_custkey * 6007) % 9000) * 100 as y
      from {{customer}}) as c
"""

# The suppliers' texts, each an area of its own.
BLOCK_AREA = """
select aoi_id + 1000000 * ord as aoi_id, 0 as ord, wkt from {aoi} where aoi_id >= 1000
"""

# In order of dependence.
VIEWS = {
    "settlement": (SETTLEMENT, ("orders", "customer", "nation")),
    "hazard": (HAZARD, ("settlement",)),
    "baseline": (BASELINE, ("settlement",)),
    "boundary": (BOUNDARY, ("nation",)),
    "block": (BLOCK, ("supplier",)),
    "aoi": (AOI, ("block",)),
    "shape": (SHAPE, ("settlement",)),
    "land": (LAND, ("customer",)),
    "block_area": (BLOCK_AREA, ("aoi",)),
    "aoi_request": (AOI_REQUEST, ("aoi",)),
    "district_boundary": (DISTRICT_BOUNDARY, ("settlement",)),
    "scope_request": (SCOPE_REQUEST, ("customer", "aoi")),
}


def derived_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a raw test table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, needs = VIEWS[name]
    return spark.sql(sql, **{n: derived_view(spark, sf_dir, n) for n in needs})

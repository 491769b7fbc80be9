"""The raw_customers fixture: dirty text columns derived from the table `customer`, without randomness or clock.

One statement for Spark and DuckDB. _row_id is the order of rows. Spark reads it with 64-bit keys, as products of 32-bit ones overflow past key 271,177.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_CUSTOMERS = """
with b as (select cast(c_custkey as int) as k from {customer}),
u as (select k, k as _row_id from b union all select k, k + 1000000 as _row_id from b where k % 100 = 12),
n as (select *,
  split_part('john,MARY,Kwame,amina,Grace,peter,Chidi,Fatou,David,Nia,samuel,Aisha,Emeka,Zainab,Thomas,leila,Kofi,Rita,michael,jean-luc', ',', cast(k % 20 + 1 as int)) as f,
  split_part('doe,SMITH,Mensah,okafor,Diallo,brown,Adeyemi,Nkrumah,williams,Osei,TRAORE,Johnson,Balogun,keita,Owusu,Garcia,abubakar,Lee,O''BRIEN', ',', cast(k % 19 + 1 as int)) as l,
  split_part('Kigali,Accra,Lagos,Nairobi,Dakar,Kampala', ',', cast(k % 6 + 1 as int)) as city,
  split_part('gmail.com,yahoo.com,outlook.com,company.co,mail.rw', ',', cast(k % 5 + 1 as int)) as dom,
  cast(200 + k * 37 % 800 as string) as pa, lpad(cast(k * 91 % 1000 as string), 3, '0') as pb, lpad(cast(k * 7919 % 10000 as string), 4, '0') as pc,
  cast(1955 + k % 61 as string) as dy, lpad(cast(1 + k * 7 % 12 as string), 2, '0') as dm, lpad(cast(1 + k * 11 % 28 as string), 2, '0') as dd,
  substring('JanFebMarAprMayJunJulAugSepOctNovDec', cast(1 + 3 * (k * 7 % 12) as int), 3) as db,
  cast(2019 + k % 6 as string) as cy, lpad(cast(1 + k * 5 % 12 as string), 2, '0') as cm, lpad(cast(1 + k * 13 % 28 as string), 2, '0') as cd,
  substring('JanFebMarAprMayJunJulAugSepOctNovDec', cast(1 + 3 * (k * 5 % 12) as int), 3) as cb
  from u)
select _row_id,
  cast(1000 + k - case when k % 50 = 37 then 30 else 0 end as string) as customer_id,
  case when k % 23 = 0 then '' when k % 29 = 0 then concat(f, '123') else f end as first_name,
  case when k % 31 = 0 then 'X' else l end as last_name,
  case k % 12 when 7 then concat('  ', lower(f), '.', lower(l), '@', upper(dom), '  ') when 8 then concat(lower(f), '.', lower(l), '@gmial.com')
    when 9 then concat(lower(f), '.', lower(l), '@@', dom) when 10 then concat(lower(f), '.', lower(l), '.at.', dom) when 11 then ''
    else concat(lower(f), '.', lower(l), '@', dom) end as email,
  case k % 8 when 0 then concat(pa, '-', pb, '-', pc) when 1 then concat('(', pa, ') ', pb, '-', pc) when 2 then concat(pa, '.', pb, '.', pc)
    when 3 then concat('+1', pa, pb, pc) when 4 then concat(pa, pb, pc) when 5 then concat('  ', pa, '-', pb, '-', pc, '  ')
    when 6 then concat(pa, '-', pb, '-', pc, ' ext.12') else '555-CALL-NOW' end as phone,
  case when k % 47 = 0 then '1850-03-15' else case k % 7 when 0 then concat(dy, '-', dm, '-', dd) when 1 then concat(dd, '/', dm, '/', dy)
    when 2 then concat(dm, '/', dd, '/', dy) when 3 then concat(dd, '-', db, '-', dy) when 4 then concat(dy, '/', dm, '/', dd)
    when 5 then 'invalid_date' else '' end end as date_of_birth,
  case when k % 17 = 0 then '' when k % 19 = 0 then 'N/A' else concat(cast(1 + k % 999 as string), ' ', l, ' Street, ', city) end as address,
  case when k % 20 = 3 then '' when k % 33 = 5 then concat('-', cast(1000 + k as string)) when k % 50 = 7 then cast(11000000 + k * 1000 as string)
    when k % 25 = 9 then concat('$', cast(20 + k % 160 as string), ',', lpad(cast(k * 7 % 1000 as string), 3, '0'))
    else concat(cast(9000 + k * 137 % 231000 as string), '.', lpad(cast(k % 100 as string), 2, '0')) end as income,
  case k % 20 when 0 then 'pending' when 1 then 'ACTV' when 2 then 'Active' when 13 then '' when 4 then 'ACTIVE' when 5 then 'Inactive'
    when 6 then 'inactive' when 7 then 'inactive' when 8 then 'inactive' when 9 then 'suspended' when 10 then 'suspended' else 'active' end as account_status,
  case when k % 61 = 0 then '2025-09-15' when k % 53 = 0 then '1950-06-30' else case (k + 2) % 7 when 0 then concat(cy, '-', cm, '-', cd)
    when 1 then concat(cd, '/', cm, '/', cy) when 2 then concat(cm, '/', cd, '/', cy) when 3 then concat(cd, '-', cb, '-', cy)
    when 4 then concat(cy, '/', cm, '/', cd) when 5 then 'invalid_date' else '' end end as created_date
from n
"""


#: The same rows and types, computed in 64 bits.
WIDE = RAW_CUSTOMERS.replace("cast(c_custkey as int) as k", "cast(c_custkey as bigint) as k").replace("select _row_id,", "select cast(_row_id as int) as _row_id,")


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WIDE, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))

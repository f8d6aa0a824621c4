"""Views over the test tables that stand in for registers, map tables and so on.

Each is valid in Spark SQL and in the checking engine's SQL; `{customer}` and the like name the tables read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # An establishment register.
    "establishment": """
        select lpad(cast(c_custkey as string), 14, '0') as siret,
               substr(lpad(cast(c_custkey as string), 14, '0'), 1, 9) as siren,
               substr(lpad(cast(c_custkey as string), 14, '0'), 10, 5) as nic,
               c_name as denominationUniteLegale,
               case c_custkey % 3 when 0 then c_mktsegment when 1 then '' else null end as enseigne1Etablissement,
               case when c_custkey % 6 = 0 then null when c_custkey % 6 = 1 then '  ' else cast(c_custkey % 200 as string) end as numeroVoieEtablissement,
               case when c_custkey % 4 = 0 then null else 'RUE' end as typeVoieEtablissement,
               concat('Allée ', n_name) as libelleVoieEtablissement,
               concat(case c_custkey % 5 when 0 then '44' when 1 then '85' when 2 then '04' when 3 then '08' else '75' end,
                      lpad(cast(c_custkey % 1000 as string), 3, '0')) as codePostalEtablissement,
               case when c_custkey % 11 = 0 then null else concat('Forêt-', n_name) end as libelleCommuneEtablissement,
               c_mktsegment as activitePrincipaleEtablissement,
               case when c_custkey % 7 = 0 then 'F' else 'A' end as etatAdministratifEtablissement
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    # A map table, coordinates still text.
    "places": """
        select c_custkey as id, c_name as Name,
               case when c_custkey % 41 = 0 then '...' when c_custkey % 43 = 0 then null when c_custkey % 47 = 0 then '0.001'
                    else cast((c_custkey * 104729 % 36000) / 100e0 - 180 as string) end as Longitude,
               case when c_custkey % 43 = 0 then null when c_custkey % 47 = 0 then '-0.001'
                    else cast((c_custkey * 7919 % 17000) / 100e0 - 85 as string) end as Latitude,
               c_custkey % 4 <> 0 as Geocode,
               case when c_custkey % 13 = 0 then '' else concat(n_name, ' ', cast(c_custkey % 40 as string)) end as Address,
               case c_custkey % 3 when 0 then null when 1 then concat(n_name, ' ', cast(c_custkey % 40 as string)) else 'ancienne' end as GeocodedAddress
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    # A map table with diff cells.
    "compared": """
        select c_custkey as id,
               case c_custkey % 4 when 0 then concat('V({{"remote":"', c_name, '","local":"old"}})')
                    when 1 then concat('V({{"remote":"","local":"', c_name, '"}})')
                    when 2 then concat('V({{"remote":null,"parent":"', c_name, '"}})') else c_name end as Name,
               case when c_custkey % 5 = 0 then concat('V({{"remote":', cast(c_custkey % 180 as string), ',"local":1}})')
                    else cast(c_custkey % 180 as string) end as Longitude,
               case when c_custkey % 6 = 0 then 'V({{"remote":0,"local":false}})' else cast(c_custkey % 85 as string) end as Latitude
        from {customer}""",
    # Known addresses; every 7th house number is unknown.
    "gazetteer": """
        select distinct concat(n_name, ' ', cast(c_custkey % 40 as string)) as address,
               n_nationkey * 2e0 as lat, (c_custkey % 40) * 3e0 as lng
        from {customer} join {nation} on c_nationkey = n_nationkey where (c_custkey % 40) % 7 <> 3""",
    # A user table whose columns go by other names.
    "clients": """
        select c_custkey as id,
               case c_custkey % 3 when 0 then '' when 1 then null else concat('Société ', c_name) end as Enseigne,
               case when c_custkey % 10 = 0 then null else c_name end as Nom,
               case when c_custkey % 8 = 0 then '' else concat(' 3 Allée ', n_name) end as Lieu,
               case when c_custkey % 9 = 0 then 0 else c_custkey end as SIRET,
               'ancien' as RaisonSociale, cast(null as string) as AdresseNormalisee
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    # A searched table and the texts typed to search it.
    "products": "select p_partkey as id, p_name as nom, concat(p_brand, ' ', p_type) as adresse from {part}",
    "typed": """
        select p_partkey as qid,
               case p_partkey % 6 when 0 then replace(p_name, 'e', 'é') when 1 then upper(replace(p_name, 'dg', 'd'))
                    when 2 then concat(p_brand, ' ', p_type) when 3 then substr(p_name, 1, 2)
                    when 4 then concat('  ', replace(p_name, 'll', 'l')) else concat(p_name, 's') end as text
        from {part}""",
    # Short texts with a letter missing, added, replaced or swapped.
    "misspelled": """
        select p_partkey as qid,
               case p_partkey % 7 when 0 then concat(substr(word, 2, 1), substr(word, 1, 1), substr(word, 3))
                    when 1 then concat(substr(word, 1, 2), substr(word, 4)) when 2 then concat(' É', word)
                    when 3 then concat(substr(word, 1, 2), 'x', substr(word, 4)) when 4 then upper(concat(word, 's'))
                    when 5 then concat(substr(p_name, 1, 3), 'z', substr(p_name, 5, 8)) else word end as text
        from (select *, split_part(p_name, ' ', cast(1 + p_partkey % 2 as int)) as word from {part})""",
    # Names in Cyrillic and Greek letters, some of which are spelled by several.
    "scripts": """
        select p_partkey as id, case p_partkey % 3
                 when 0 then translate(p_name, 'abcdefghijklmnoprstuvwxyz', 'абцдефгхійклмнопрстувщэыю')
                 when 1 then concat('ЖЁ ', translate(upper(p_name), 'ABCDEFGHIKLMNOPRSTUWXYZ', 'АБЧДЕФГЯИКЛМНОПРСТУШХЫЗ'))
                 else concat('Ψ', translate(p_name, 'abcdefghiklmnoprstuwxyz', 'αβχδεφγήικλμνοπρστυωξψζ'), 'ς é ß') end as text
        from {part}""",
    # Towns and streets that share words, searched by texts that match both.
    "streets": """
        select c_custkey as id, concat('Forêt-', n_name) as nom, concat(cast(c_custkey % 200 as string), ' RUE Allée ', n_name) as adresse
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "asked": """
        select s_suppkey as qid,
               case s_suppkey % 4 when 0 then concat('nation_', cast(s_nationkey as string)) when 1 then concat('rue alee nation_', cast(s_nationkey as string))
                    when 2 then concat('Foret nation_', cast(s_nationkey as string)) else concat(cast(s_suppkey % 200 as string), ' rue allée') end as text
        from {supplier}""",
    # Values written back by id: unknown ids, several for one id, empty ones.
    "choices": """
        select o_custkey * 2 as id, o_orderkey as step, lpad(cast(o_orderkey as string), 14, '0') as SIRET,
               case when o_orderstatus = 'P' then '' else concat('Maison ', o_orderstatus) end as RaisonSociale,
               o_orderpriority as AdresseNormalisee
        from {orders}""",
    # Diff cells of many kinds.
    "diff_cells": """
        select event_id, case event_id % 8
                 when 0 then concat('V({{"remote":"', event_type, '"}})')
                 when 1 then concat('V({{"remote":"","local":"', event_type, '"}})')
                 when 2 then concat('V({{"local":0,"parent":"', event_type, '"}})')
                 when 3 then concat('V({{"remote":false,"parent":"', event_type, '"}})')
                 when 4 then concat('V({{"other":"', event_type, '"}})')
                 when 5 then concat('V({{"remote":', cast(event_id as string), '}})')
                 when 6 then null else event_type end as cell
        from {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = set(re.findall(r"(?<!{){(\w+)}(?!})", VIEWS[name]))
    return spark.sql(VIEWS[name], **{table: read(spark, sf_dir, table) for table in tables})


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view_sql(name: str) -> str:
    return re.sub(r"(?<!{){(\w+)}(?!})", r"\1", VIEWS[name]).replace("{{", "{").replace("}}", "}")

"""The same results in plain SQL."""

from __future__ import annotations

from workload.standins import VIEWS, view_sql

SPELLINGS = [
    ("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"),
    ("đ", "d"), ("Đ", "D"), ("þ", "th"), ("Þ", "Th"), ("ð", "d"), ("Ð", "D"), ("«", "<<"), ("»", ">>"),
    ("‐", "-"), ("‑", "-"), ("–", "-"), ("—", "--"), ("‘", "''"), ("’", "''"), ("‚", ","), ("“", '"'), ("”", '"'), ("„", ",,"), ("…", "..."),
]

# Letters of other scripts, capitals like their small letters: several ASCII letters, then one.
SEVERAL = {"ё": "io", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "φ": "ph", "χ": "kh", "ψ": "ps"}
ONE = ("абвгдеийклмнопрстуфыэзіαβγδεήικλμνοπρστυωξςζ", "abvgdeiiklmnoprstufyeziabgdeeiklmnoprstuoxsz")


def other_scripts(text: str) -> str:
    text = f"lower({text})"
    for char, ascii_ in SEVERAL.items():
        text = f"replace({text}, '{char}', '{ascii_}')"
    return f"translate({text}, '{ONE[0]}', '{ONE[1]}')"


WITH = "with " + ",\n".join(f"{name} as ({view_sql(name)})" for name in VIEWS)


def n1(text: str) -> str:
    for char, ascii_ in SPELLINGS:
        text = f"replace({text}, '{char}', '{ascii_}')"
    return rf"trim(regexp_replace(lower(strip_accents({text})), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def n2(text: str) -> str:
    plain = rf"lower(regexp_replace(strip_accents(coalesce({text}, '')), '[\^`¨¯´·¸]', '', 'g'))"
    return rf"regexp_replace({plain}, '^[\s\x0b\p{{Z}}]+|[\s\x0b\p{{Z}}]+$', '', 'g')"


def address(*parts: str) -> str:
    kept = ", ".join(f"case when trim({part}) <> '' then {part} end" for part in parts)
    return f"concat_ws(' ', {kept})"


def grams(text: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({text}) - 1, 1)), lambda i: substr({text}, i, 3)))"


ADDRESS = address("numeroVoieEtablissement", "typeVoieEtablissement", "libelleVoieEtablissement")
NAME = "coalesce(nullif(enseigne1Etablissement, ''), nullif(denominationUniteLegale, ''), '')"
TOWN = "coalesce(libelleCommuneEtablissement, '')"
KEPT = "(codePostalEtablissement like '44%' or codePostalEtablissement like '85%')"

REGISTER = f"""{WITH}, built as (
  select siret, siren, {NAME} as nom, {ADDRESS} as adresse, codePostalEtablissement as code_postal, {TOWN} as commune,
         activitePrincipaleEtablissement as ape
  from establishment where {KEPT} and etatAdministratifEtablissement = 'A')
select row_number() over (order by siret nulls first) - 1 as id, *, {n1("concat(nom, ' ', adresse, ' ', commune)")} as search from built"""

COLUMNS = """siret, siren, nic, denominationUniteLegale, enseigne1Etablissement, numeroVoieEtablissement, typeVoieEtablissement,
  libelleVoieEtablissement, codePostalEtablissement, libelleCommuneEtablissement, activitePrincipaleEtablissement, etatAdministratifEtablissement"""

CLIENT = """coalesce(nullif(Enseigne, ''), nullif(Nom, ''), '') as nom, coalesce(nullif(Lieu, ''), '') as adresse,
  case when SIRET = 0 then '' else cast(SIRET as varchar) end as siret"""

POINTS = f"""{WITH}, points as (
  select id, Name as name, try_cast(Longitude as double) as lng, try_cast(Latitude as double) as lat from places
  where Longitude <> '...' and try_cast(Longitude as double) is not null and try_cast(Latitude as double) is not null
    and not (abs(try_cast(Longitude as double)) < 0.01 and abs(try_cast(Latitude as double)) < 0.01))"""

NEEDED = """Geocode and coalesce(Address, '') <> '' and case when coalesce(GeocodedAddress, '') <> '' then GeocodedAddress <> Address
  else Longitude is null or Longitude = '' or coalesce(try_cast(Longitude as double) = 0, false) end"""



def geocoded(places: str = "places") -> str:
    return f"""{WITH}, edited as (
  select * replace (
    case when id % 10 = 0 then '99' else Longitude end as Longitude,
    case when id % 10 = 0 then '88' else Latitude end as Latitude,
    case when id % 10 = 0 then Address else GeocodedAddress end as GeocodedAddress)
  from places),
first as (
  select address, lat, lng from (select *, row_number() over (partition by address order by lat, lng) as rn from gazetteer) where rn = 1),
needed as (select id, Address as used from {places} where {NEEDED})
select p.id,
  case when n.id is null then try_cast(p.Longitude as double) else f.lng end as Longitude,
  case when n.id is null then try_cast(p.Latitude as double) else f.lat end as Latitude,
  case when n.id is null then p.GeocodedAddress else n.used end as GeocodedAddress
from {places} p left join needed n on p.id = n.id left join first f on f.address = n.used"""


# Points that moved, went and came.
MOVED = f"""{POINTS.replace(", points as (", ", before as (")}, points as (
  select id, name, lng, case when id % 5 = 0 then lat / 2 else lat end as lat from before where id % 7 <> 0
  union all select id + 1000000, name, lng / 2, lat from before where id % 11 = 0)"""


def clusters(zooms: str, selected: str, points: str = POINTS) -> str:
    radians = "radians(greatest(least(lat, 85.0511), -85.0511))"
    return f"""{points}, zooms as (select unnest({zooms}) as zoom), pixels as (
  select cast(zoom as integer) as zoom, id, lat, lng, {selected} as selected,
    cast(floor(256 * pow(2.0, zoom) * (lng + 180) / 360 / 30) as bigint) as cx,
    cast(floor(256 * pow(2.0, zoom) * (0.5 - ln((1 + sin({radians})) / (1 - sin({radians}))) / (4 * pi())) / 30) as bigint) as cy
  from points, zooms),
cells as (
  select zoom, case when zoom >= 18 then id else cx end as cx, case when zoom >= 18 then null else cy end as cy,
    count(*) as n, round(sum(lat) / count(*), 9) as lat, round(sum(lng) / count(*), 9) as lng,
    min(lat) as min_lat, min(lng) as min_lng, max(lat) as max_lat, max(lng) as max_lng,
    case when count(*) = 1 then min(id) end as id,
    case when count(*) < 10 then 'small' when count(*) < 100 then 'medium' else 'large' end as size_class,
    bool_or(selected) as has_selected
  from pixels group by 1, 2, 3)"""


def search(queries: str, records: str) -> str:
    return f"""{WITH}, asked_for as (
  select qid, {n2("text")} as q from {queries} where length(trim(text)) >= 3),
q_grams as (select q, unnest({grams("q")}) as gram from (select distinct q from asked_for)),
q_size as (select q, count(*) as size from q_grams group by q),
fields as (select id, 0.7 as weight, {n2("nom")} as text from {records} union all select id, 0.3 as weight, {n2("adresse")} as text from {records}),
f_grams as (select id, weight, unnest({grams("text")}) as gram from fields),
misses as (
  select q, id, weight, 1 - count(*) / cast(any_value(size) as double) as miss
  from q_grams join f_grams using (gram) join q_size using (q) group by q, id, weight),
scores as (
  select q, id, round(exp(sum(cast(weight as double) * ln(greatest(miss, 0.001)) order by weight desc)), 6) as score
  from misses where miss <= 0.35 group by q, id),
ranked as (select *, row_number() over (partition by q order by score, id) as rank from scores),
found as (select qid, cast(rank as integer) as rank, id, score from asked_for join ranked using (q) where rank <= 5)"""


def search_by_place(queries: str, records: str, distance: int) -> str:
    """Trigrams are shared if they stand at most 0.35 * distance later in the field; the miss grows by the shift of most."""
    return f"""{WITH}, asked_for as (
  select qid, {n2("text")} as q from {queries} where length(trim(text)) >= 3),
q_grams as (select q, gram, instr(q, gram) as at from (select q, unnest({grams("q")}) as gram from (select distinct q from asked_for))),
q_size as (select q, count(*) as size from q_grams group by q),
fields as (select id, 0.7 as weight, {n2("nom")} as text from {records} union all select id, 0.3 as weight, {n2("adresse")} as text from {records}),
f_grams as (select id, weight, gram, instr(text, gram) as at from (select *, unnest({grams("text")}) as gram from fields)),
shifts as (
  select q, id, weight, f.at - q_grams.at as shift, count(*) as n from q_grams join f_grams f using (gram)
  where f.at - q_grams.at <= floor(0.35 * {distance}) group by all),
misses as (
  select q, id, weight, 1 - sum(n) / cast(any_value(size) as double) + greatest(arg_min(shift, {{'n': -n, 's': shift}}), 0) / cast({distance} as double) as miss
  from shifts join q_size using (q) group by q, id, weight),
scores as (
  select q, id, round(exp(sum(cast(weight as double) * ln(greatest(miss, 0.001)) order by weight desc)), 6) as score
  from misses where miss <= 0.35 group by q, id),
ranked as (select *, row_number() over (partition by q order by score, id) as rank from scores),
found as (select qid, cast(rank as integer) as rank, id, score from asked_for join ranked using (q) where rank <= 5)"""


def words(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def search_misspelled(queries: str, records: str) -> str:
    """Edit distances of all typed texts to all pieces of up to three words."""
    return rf"""{WITH}, asked_for as (
  select * from (select qid, {words(n2("text"))} as q from {queries} where length(trim(text)) >= 3) where length(q) between 3 and 12),
fields as (select id, 0.7 as weight, {n2("nom")} as text from {records} union all select id, 0.3 as weight, {n2("adresse")} as text from {records}),
cut as (select id, weight, string_split({words("text")}, ' ') as w from fields where length(text) >= 3),
pieces as (
  select distinct id, weight, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])),
    list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))))) as piece from cut),
near as (
  select q, piece, levenshtein(piece, q) as edits from (select distinct q from asked_for), (select distinct piece from pieces)
  where length(piece) >= 2 and levenshtein(piece, q) <= case when length(q) < 6 then 1 else 2 end),
misses as (select q, id, weight, min(edits) / cast(length(q) as double) as miss from near join pieces using (piece) group by q, id, weight),
scores as (select q, id, round(exp(sum(cast(weight as double) * ln(greatest(miss, 0.001)) order by weight desc)), 6) as score from misses group by q, id),
ranked as (select *, row_number() over (partition by q order by score, id) as rank from scores),
spelled as (select qid, cast(rank as integer) as rank, id, score from asked_for join ranked using (q) where rank <= 5)"""


DEBOUNCED = """select user_id, ts, event_type from
  (select *, lead(ts) over (partition by user_id order by ts, event_id) as following from events)
where (following is null or following - ts >= interval 2 hours) and length(trim(event_type)) >= 3"""

# Sixths of the time come in the order 0, 2, 1, 3, 5, 4; a batch's inputs before the latest time of earlier batches less one
# and a half sixths are late. Bursts are certain two hours before the latest time of all, less as much.
DEBOUNCED_LATE = """with edges as (select min(ts) as s, max(ts) as e, (max(ts) - min(ts)) / 6 as sixth from events),
lengths as (select *, to_seconds(cast(floor(extract(epoch from sixth) * 1.5) as bigint)) as delay from edges),
parts as (
  select events.*, (case when ts >= s + 5 * sixth then 5 when ts >= s + 4 * sixth then 4 when ts >= s + 3 * sixth then 3
    when ts >= s + 2 * sixth then 2 when ts >= s + sixth then 1 else 0 end) as part, delay from events, lengths),
batches as (select *, case part when 1 then 2 when 2 then 1 when 4 then 5 when 5 then 4 else part end as batch from parts),
seen as (select batch, max(ts) as latest from batches group by batch),
marks as (select b.batch, max(a.latest) as latest from seen a join seen b on a.batch < b.batch group by b.batch),
judged as (select batches.*, coalesce(ts < marks.latest - delay, false) as late from batches left join marks using (batch)),
following as (select *, lead(ts) over (partition by user_id order by ts, event_id) as next from judged where not late)
select user_id, ts, event_type, false as late from following
where (next is null or next - ts >= interval 2 hours) and length(trim(event_type)) >= 3 and ts + interval 2 hours <= (select max(ts) from events) - delay
union all select user_id, ts, event_type, true from judged where late"""

SELECTED_IN_CLUSTER = clusters("range(18)", "id in (select c_custkey from customer where c_acctbal < 0)") + " select zoom, cx, cy, n, has_selected from cells"

UPDATED = f"""{WITH}, last as (select * from (select *, row_number() over (partition by id order by step desc) as rn from choices) where rn = 1)
select c.id, c.Enseigne, c.Nom, c.Lieu, case when l.id is null then cast(c.SIRET as varchar) else l.SIRET end as SIRET,
  case when l.id is null then c.RaisonSociale else l.RaisonSociale end as RaisonSociale,
  case when l.id is null then c.AdresseNormalisee else l.AdresseNormalisee end as AdresseNormalisee
from clients c left join last l on c.id = l.id"""

def updated(state: str, choices: str) -> str:
    return f"""select c.id, c.Enseigne, c.Nom, c.Lieu, case when l.id is null then cast(c.SIRET as varchar) else l.SIRET end as SIRET,
  case when l.id is null then c.RaisonSociale else l.RaisonSociale end as RaisonSociale,
  case when l.id is null then c.AdresseNormalisee else l.AdresseNormalisee end as AdresseNormalisee, '{state}' as state
from clients c left join (select * from (select *, row_number() over (partition by id order by step desc) as rn from {choices}) where rn = 1) l on c.id = l.id"""


ORACLE = {
    "register_build": REGISTER,
    "scan_register_csv": f"{WITH} select {COLUMNS} from establishment",
    "scan_register_csv_orders": f"{WITH} select {COLUMNS} from (select * replace (replace(libelleVoieEtablissement, ' ', chr(10)) as libelleVoieEtablissement) from establishment)",
    "scan_register_parquet": f"{WITH} select {COLUMNS} from establishment",
    "columns_to_rows": """with numbered as (
  select *, o_orderkey // 1000 as part, row_number() over w - 1 as position, count(*) over (partition by o_custkey, o_orderkey // 1000) as n
  from orders window w as (partition by o_custkey, o_orderkey // 1000 order by o_orderkey)),
sized as (select *, n - case when o_custkey % 3 = 0 then 1 else 0 end as n_status from numbered)
select o_custkey, part, position, case when position < n_status then o_orderstatus end as status,
  case when o_custkey % 5 <> 0 then o_orderkey end as id, o_orderpriority as priority
from sized where position < case when o_custkey % 5 = 0 then n_status else n end""",
    "flatten_company_response": """with items as (
  select s_suppkey, cast(0 as bigint) as position, s_name as nom, case when s_suppkey % 4 = 0 then concat('Rue ', s_nationkey) end as adresse,
    lpad(cast(s_suppkey as varchar), 14, '0') as siret, s_nationkey
  from supplier where s_suppkey % 7 <> 0
  union all select s_suppkey, 1, '', null, null, s_nationkey from supplier where s_suppkey % 7 <> 0 and s_suppkey % 4 = 0),
whole as (
  select *, concat('{"nom_complet":"', nom, '"',
    case when siret is not null then concat(',"siege":{"siret":"', siret, '"', case when adresse is not null then concat(',"adresse":"', adresse, '"') else '' end, '}') else '' end,
    ',"pays":', s_nationkey, '}') as origine
  from items)
select s_suppkey, position, nom, coalesce(adresse, '') as adresse, coalesce(siret, '') as siret,
  cast(null as double) as latitude, cast(null as double) as longitude, origine, origine as source
from whole""",
    "pick_snapshot_resource": r"""with resources as (
  select page_id // 8 as catalogue, page_id,
    case page_id % 3 when 0 then 'Fichier StockEtablissement' when 1 then 'STOCKETABLISSEMENT historique' end as title,
    case page_id % 4 when 0 then 'Parquet' when 1 then 'csv' end as format,
    concat(url, case when page_id % 5 = 0 then '.PARQUET' else '/' end) as url
  from pages),
fitting as (
  select *, row_number() over (partition by catalogue order by page_id) as place from resources
  where contains(lower(coalesce(title, '')), 'stocketablissement')
    and (lower(coalesce(format, '')) = 'parquet' or ends_with(lower(coalesce(url, '')), '.parquet')))
select catalogue, title, format, url, regexp_extract(url, '([^/]*)/*$', 1) as file_name
from fitting where place = 1 and catalogue % 9 not in (0, 1)""",
    "scan_table": "select * from customer",
    "stream_records": "select * from events",
    "export_register_json": REGISTER,
    "export_register_json_text": f"""with built as ({REGISTER})
select cast(json_object('id', id, 'siret', siret, 'siren', siren, 'nom', nom, 'adresse', adresse, 'code_postal', code_postal, 'commune', commune,
  'ape', case when id % 3 <> 0 then ape end, 'search', search) as varchar) as line from built""",
    "update_by_id": UPDATED,
    "update_by_id_shuffled": UPDATED,
    "update_versions": f"{WITH}, early as (select * from choices where step <= (select max(step) // 3 from choices)) "
    + updated("first", "early") + " union all " + updated("last", "choices"),
    "row_counts": f"""{WITH} select 'read' as stage, count(*) as rows from establishment
union all select 'kept', count(*) from establishment where {KEPT}
union all select 'exported', count(*) from establishment where {KEPT} and etatAdministratifEtablissement = 'A'""",
    "rename_columns": """select c_custkey as id, c_name as "Name", c_name as "Label", c_mktsegment as c_name, c_nationkey as c_acctbal, c_acctbal as c_nationkey
from customer""",
    "map_columns": f"""{WITH} select id, nom as "Nom", adresse as "Adresse", siret as "SIRET" from (select id, {CLIENT} from clients)""",
    "check_columns": f"{WITH} select id, Name, Longitude, Latitude, Geocode, Address from places",
    "project_register": f"{WITH} select {COLUMNS} from establishment",
    "prepare_searchable": f"""{WITH}, results as (select id, {CLIENT} from clients)
select *, {n2("nom")} as searchable_nom, {n2("adresse")} as searchable_adresse from results""",
    "unified_result": f"""{WITH} select {CLIENT}, cast(null as double) as latitude, cast(null as double) as longitude,
  id as origine_id, Lieu as source_lieu from clients""",
    "map_info": """select c_custkey as id, c_name as name, cast(c_custkey % 180 as varchar) as lng,
  case when c_custkey % 6 = 0 then '{"remote":0,"local":false}' else cast(c_custkey % 85 as varchar) end as lat
from customer where not (c_custkey % 5 = 0 and c_custkey % 180 = 0)
union all select c_custkey, c_name, '1', case when c_custkey % 6 = 0 then '{"remote":0,"local":false}' else cast(c_custkey % 85 as varchar) end
from customer where c_custkey % 5 = 0 and c_custkey % 180 = 0""",
    "filter_postal_prefix": f"{WITH} select siret, codePostalEtablissement from establishment where {KEPT}",
    "filter_active": f"{WITH} select siret, etatAdministratifEtablissement from establishment where etatAdministratifEtablissement = 'A'",
    "filter_valid_points": f"{POINTS} select id, name, lng, lat from points",
    "geocode_candidates": f"{WITH} select id, Address, Longitude from places where {NEEDED}",
    "filter_short_queries": """with typed as (
  select c_custkey as qid, concat(' ', substr(c_mktsegment, 1, c_custkey % 6), '  ') as text from customer
  union all select conv_id, text from conversations)
select * from typed where length(trim(text)) >= 3""",
    "single_record": f"{WITH} select id, Name from places where id in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "fuzzy_search_topk": f"{search('typed', 'products')} select * from found",
    "fuzzy_search_two_fields": f"{search('asked', 'streets')} select * from found",
    "fuzzy_search_saved_index": f"{search('typed', 'products')} select * from found",
    "fuzzy_search_shuffled": f"{search('typed', 'products')} select * from found",
    "fuzzy_search_by_place": f"{search_by_place('asked', 'streets', 40)} select * from found",
    "live_index_search": search("typed", "(select id, nom, case when id % 9 = 0 then concat(adresse, ' neuf') else adresse end as adresse from products where id % 7 <> 0)")
    + " select * from found",
    "misspelled_search": f"{search_misspelled('misspelled', 'products')} select * from spelled",
    "misspelled_search_two_fields": f"{search_misspelled('asked', 'streets')} select * from spelled",
    "choose_and_write_repeated": f"""{search('typed', 'products')},
best as (select *, row_number() over (partition by qid // 2 order by score, id) as place from found where rank = 1)
select t.id, case when f.id is null then '' else cast(p.id as varchar) end as "SIRET",
  coalesce(p.nom, '') as "RaisonSociale", coalesce(p.adresse, '') as "AdresseNormalisee"
from (select distinct qid // 2 as id from typed) t left join best f on f.qid // 2 = t.id and f.place = 1 left join products p on p.id = f.id""",
    "choose_and_write": f"""{search('typed', 'products')}
select t.qid as id, t.text, case when f.id is null then '' else cast(p.id as varchar) end as "SIRET",
  coalesce(p.nom, '') as "RaisonSociale", coalesce(p.adresse, '') as "AdresseNormalisee"
from typed t left join (select * from found where rank = 1) f on f.qid = t.qid left join products p on p.id = f.id""",
    "geocode_join": geocoded(),
    "geocode_join_shuffled": geocoded(),
    "selected_in_cluster": SELECTED_IN_CLUSTER,
    "selected_in_cluster_shuffled": SELECTED_IN_CLUSTER,
    "cluster_points": clusters("range(19)", "id = 7") + " select * from cells",
    "cluster_changes": clusters("range(19)", "id % 1000000 = 7 or id % 10 = 0", MOVED) + " select * from cells",
    "bounds": f"""{POINTS}, box as (
  select min(lat) as min_lat, min(lng) as min_lng, max(lat) as max_lat, max(lng) as max_lng,
    256 * (max(lng) - min(lng)) / 360 as across,
    256 * (ln((1 + sin(radians(max(lat)))) / (1 - sin(radians(max(lat))))) - ln((1 + sin(radians(min(lat)))) / (1 - sin(radians(min(lat)))))) / (4 * pi()) as down
  from points)
select min_lat, min_lng, max_lat, max_lng, cast(least(greatest(floor(log2(least(1280 / across, 800 / down))), 0), 15) as integer) as zoom from box""",
    "cluster_coverage": clusters("range(18)", "false") + " select zoom, cx, cy, min_lat, min_lng, max_lat, max_lng from cells where n > 1",
    "last_marker_per_id": """select user_id as id, ts, event_id, value from
  (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""",
    "first_match": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from
  (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rn from lineitem) where rn = 1""",
    "assign_ids": "select row_number() over (order by o_orderpriority, o_orderkey) - 1 as id, o_orderpriority, o_orderkey from orders",
    "normalize_index": f"select doc_id, {n1('text')} as text from documents",
    "normalize_scripts": f"{WITH} select id, {n1(other_scripts('text'))} as text from scripts",
    "normalize_query": f"select doc_id, {n2('text')} as text from documents",
    "build_address": f"{WITH} select siret, {ADDRESS} as adresse from establishment",
    "pick_name": f"{WITH} select siret, {NAME} as nom, {TOWN} as commune from establishment",
    "search_text": f"""{WITH} select siret,
  {n1("concat_ws(' ', denominationUniteLegale, libelleVoieEtablissement, libelleCommuneEtablissement)")} as search from establishment""",
    "parse_diff_cell": """select event_id, case event_id % 8 when 4 then concat('{"other":"', event_type, '"}')
  when 5 then cast(event_id as varchar) when 6 then null else event_type end as value from events""",
    "file_name_from_url": "select page_id, regexp_extract(url, '([^/]*)/*$', 1) as file_name from pages",
    "size_class": """select o_custkey, count(*) as n, case when count(*) < 10 then 'small' when count(*) < 100 then 'medium' else 'large' end as size_class
from orders group by o_custkey""",
    "marker_layer": f"{POINTS} select id, case when id = 7 then 'selectedMarker' else 'otherMarkers' end as layer from points",
    "label_text": f"{POINTS} select id, case when id % 3 = 0 then '' else coalesce(name, '') end as label from points",
    "debounce": DEBOUNCED,
    "debounce_stream": DEBOUNCED,
    "debounce_late": DEBOUNCED_LATE,
    "geocode_stream": geocoded("edited"),
}

"""One query per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from placebook.functions.cells import parse_diff_cell
from placebook.functions.geo import size_class
from placebook.functions.text import file_name_from_url, first_filled, join_filled, normalize_index, normalize_query, search_text
from placebook.operators.clusters import SINGLE_FROM, bounds, cluster_points, fit_zoom
from placebook.operators.columns import MAP_OPTIONAL, MAP_REQUIRED, check_columns, map_columns, map_info, prepare_searchable, project_register, rename_columns
from placebook.operators.filters import filter_active, filter_prefix, filter_short_queries, select_records
from placebook.operators.geocode import geocode_candidates, geocode_table
from placebook.operators.ids import assign_ids
from placebook.operators.joins import deal_rows
from placebook.operators.latest import first_match, last_per_id
from placebook.operators.liveindex import LiveIndex
from placebook.operators.pyramid import Pyramid
from placebook.operators.search import build_index, fuzzy_search, load_index
from placebook.operators.spelling import build_spelling, load_spelling, misspelled_search
from placebook.operators.update import update_by_id
from placebook.plans.mapview import map_points, markers
from placebook.plans.picker import search_table, write_best
from placebook.plans.register import build_register, export_register
from placebook.session import new_folder
from placebook.sinks.register import write_register
from placebook.sinks.versions import VersionedTable, update_stream
from placebook.sources.nested import columns_to_rows, flatten_companies, pick_resource
from placebook.sources.register import read_changes, read_register, scan_table
from placebook.streaming.debounce import debounce, debounce_batches, debounce_stream, open_bursts, read_bursts, read_late
from placebook.streaming.geocoding import geocode_stream, read_answers, with_answers
from workload.standins import read, view

CLIENTS = {"Nom": "Enseigne", "Adresse": "Lieu", "SIRET": "Siret14"}
SELECTED = 7
GAP = "2 hours"
DEGREES = 9  # decimals kept of mean coordinates, whose last bits depend on the order of adding


def register_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_register(view(spark, sf_dir, "establishment"))


def scan_register_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "register-csv")
    as_is = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    view(spark, sf_dir, "establishment").write.options(**as_is).csv(folder, header=True)
    return read_register(spark, folder, "csv")


def scan_register_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "register-parquet")
    view(spark, sf_dir, "establishment").write.parquet(folder)
    return read_register(spark, folder, "parquet")


def scan_register_csv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose columns come in different orders, with line breaks in cells."""
    folder = new_folder(spark, "register-csv-orders")
    as_is = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    register = view(spark, sf_dir, "establishment").withColumn("libelleVoieEtablissement", F.replace("libelleVoieEtablissement", F.lit(" "), F.lit("\n")))
    register.where("siret % 2 = 0").write.options(**as_is).csv(folder, header=True)
    register.where("siret % 2 = 1").select(*reversed(register.columns)).write.mode("append").options(**as_is).csv(folder, header=True)
    return read_register(spark, folder, "csv", multi_line=True)


def column_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables held by column, at most 1,000 orders each; some columns are too short, too long or empty."""
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")))
    grouped = read(spark, sf_dir, "orders").groupBy("o_custkey", F.expr("o_orderkey div 1000").alias("part")).agg(rows.alias("r"))
    return grouped.select(
        "o_custkey",
        "part",
        F.expr("if(o_custkey % 3 = 0, slice(r.o_orderstatus, 1, size(r) - 1), r.o_orderstatus)").alias("status"),
        F.expr("if(o_custkey % 5 = 0, array(), r.o_orderkey)").alias("id"),
        F.expr("if(o_custkey % 3 = 1, array_append(r.o_orderpriority, 'extra'), r.o_orderpriority)").alias("priority"),
    )


def columns_to_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = columns_to_rows(column_tables(spark, sf_dir), ["status", "id", "priority"], keep=["o_custkey", "part"])
    return rows.withColumn("position", F.col("position").cast("bigint"))


def flatten_company_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        """to_json(named_struct('results', case
             when s_suppkey % 7 = 0 then null
             when s_suppkey % 4 = 0 then array(
               named_struct('nom_complet', s_name, 'siege', named_struct('siret', lpad(cast(s_suppkey as string), 14, '0'), 'adresse', concat('Rue ', s_nationkey)), 'pays', s_nationkey),
               named_struct('nom_complet', '', 'siege', null, 'pays', s_nationkey))
             else array(
               named_struct('nom_complet', s_name, 'siege', named_struct('siret', lpad(cast(s_suppkey as string), 14, '0'), 'adresse', cast(null as string)), 'pays', s_nationkey))
           end)) as answer""",
    )
    flat = flatten_companies(answers, keep=["s_suppkey"])
    return flat.withColumn("position", F.col("position").cast("bigint"))


def pick_snapshot_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    resource = F.expr(
        """named_struct('page_id', page_id,
             'title', case page_id % 3 when 0 then 'Fichier StockEtablissement' when 1 then 'STOCKETABLISSEMENT historique' else null end,
             'format', case page_id % 4 when 0 then 'Parquet' when 1 then 'csv' else null end,
             'url', concat(url, case when page_id % 5 = 0 then '.PARQUET' else '/' end))"""
    )
    catalogues = read(spark, sf_dir, "pages").groupBy(F.expr("page_id div 8").alias("catalogue")).agg(F.sort_array(F.collect_list(resource)).alias("r"))
    answers = catalogues.selectExpr(
        "catalogue",
        """to_json(named_struct('data', case catalogue % 9 when 0 then slice(array(named_struct('resources', r)), 1, 0)
             when 1 then array(named_struct('resources', slice(r, 1, 0)), named_struct('resources', r))
             else array(named_struct('resources', r)) end)) as answer""",
    )
    return pick_resource(answers, keep=["catalogue"])


def scan_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "customer").createOrReplaceTempView("placebook_customer")
    return scan_table(spark, "placebook_customer")


def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return run_stream(read_changes(spark, sf_dir, schema, glob="events.parquet"))


def run_stream(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there and reads its result."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, "stream")
    sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    sink.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def export_register_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, folder = register_build(spark, sf_dir), new_folder(spark, "register-json")
    write_register(built, folder)
    return spark.read.schema(built.schema).json(folder)


def export_register_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as they are written, with null cells."""
    built, folder = register_build(spark, sf_dir), new_folder(spark, "register-json")
    write_register(built.withColumn("ape", F.expr("if(id % 3 = 0, null, ape)")), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


def update_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices come as a stream of three files; the table as it was after the first batch, and as it is after all of them
    and the first once more.
    """
    folder, columns = new_folder(spark, "versions"), ["SIRET", "RaisonSociale", "AdresseNormalisee"]
    clients = view(spark, sf_dir, "clients").withColumn("SIRET", F.col("SIRET").cast("string"))
    table, choices = VersionedTable.create(clients, f"{folder}/table", ["id"]), view(spark, sf_dir, "choices")
    third = choices.agg(F.max("step")).first()[0] // 3
    for low, high in ((-1, third), (third, 2 * third), (2 * third, 4 * third)):
        choices.where((F.col("step") > low) & (F.col("step") <= high)).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    changes = read_changes(spark, f"{folder}/feed", choices.schema, files_per_batch=1)
    update_stream(changes, table, columns, ["step"], f"{folder}/checkpoint", "choices").awaitTermination()
    table.update(choices.where(F.col("step") <= third), columns, ["step"], ("choices", 0))
    return table.read(1).withColumn("state", F.lit("first")).unionByName(table.read().withColumn("state", F.lit("last")))


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = export_register(view(spark, sf_dir, "establishment"), new_folder(spark, "register-json"))
    return spark.createDataFrame(list(counts.items()), "stage string, rows bigint")


def update_by_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = view(spark, sf_dir, "clients").withColumn("SIRET", F.col("SIRET").cast("string"))
    return update_by_id(clients, view(spark, sf_dir, "choices"), ["SIRET", "RaisonSociale", "AdresseNormalisee"], order=["step"])


def update_by_id_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = view(spark, sf_dir, "clients").withColumn("SIRET", F.col("SIRET").cast("string"))
    return update_by_id(clients, view(spark, sf_dir, "choices"), ["SIRET", "RaisonSociale", "AdresseNormalisee"], order=["step"], limit=0)


def rename_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain, a swap, and one column for two names."""
    mapping = {"id": "c_custkey", "Name": "c_name", "Label": "c_name", "c_name": "c_mktsegment", "c_acctbal": "c_nationkey", "c_nationkey": "c_acctbal", "Gone": None}
    return rename_columns(read(spark, sf_dir, "customer"), mapping)


def map_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_columns(view(spark, sf_dir, "clients"), CLIENTS)


def check_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_columns(view(spark, sf_dir, "places").drop("GeocodedAddress"), ["id", *MAP_REQUIRED], MAP_OPTIONAL)


def project_register_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_register(view(spark, sf_dir, "establishment").withColumn("dateCreation", F.current_date()))


def prepare_searchable_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepare_searchable(view(spark, sf_dir, "clients"), CLIENTS)
    return ready.select("id", "result.nom", "result.adresse", "result.siret", "searchable_nom", "searchable_adresse")


def unified_result_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = prepare_searchable(view(spark, sf_dir, "clients"), CLIENTS).select("result.*")
    return results.select("nom", "adresse", "siret", "latitude", "longitude", F.col("origine.id").alias("origine_id"), F.col("source.Lieu").alias("source_lieu"))


def map_info_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_info(view(spark, sf_dir, "compared"))


def filter_postal_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_prefix(view(spark, sf_dir, "establishment")).select("siret", "codePostalEtablissement")


def filter_active_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_active(view(spark, sf_dir, "establishment")).select("siret", "etatAdministratifEtablissement")


def filter_valid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_points(view(spark, sf_dir, "places"))


def geocode_candidates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geocode_candidates(view(spark, sf_dir, "places")).select("id", "Address", "Longitude")


def filter_short_queries_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = read(spark, sf_dir, "customer").selectExpr("c_custkey as qid", "concat(' ', substr(c_mktsegment, 1, cast(c_custkey % 6 as int)), '  ') as text")
    said = read(spark, sf_dir, "conversations").selectExpr("conv_id as qid", "text")
    return filter_short_queries(typed.unionByName(said))


def single_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = read(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("id"))
    return select_records(view(spark, sf_dir, "places"), chosen).select("id", "Name")


def fuzzy_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_search(view(spark, sf_dir, "typed"), view(spark, sf_dir, "products"))


def fuzzy_search_two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_search(view(spark, sf_dir, "asked"), view(spark, sf_dir, "streets"))


def fuzzy_search_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index saved with more ids per text than are asked for, then loaded."""
    folder = new_folder(spark, "saved-index")
    build_index(view(spark, sf_dir, "products"), depth=7).save(folder)
    return fuzzy_search(view(spark, sf_dir, "typed"), load_index(spark, folder))


def fuzzy_search_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved index; matches near the start of a field are preferred."""
    folder = new_folder(spark, "saved-index")
    build_index(view(spark, sf_dir, "streets")).save(folder)
    return fuzzy_search(view(spark, sf_dir, "asked"), load_index(spark, folder), distance=40.0)


def fuzzy_search_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way that a search takes where nothing can be broadcast."""
    return fuzzy_search(view(spark, sf_dir, "typed"), view(spark, sf_dir, "products"), limit=0)


def live_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products come in three batches, some of them again with another address, and some go; then they are searched."""
    products, index = view(spark, sf_dir, "products"), LiveIndex.create(spark, new_folder(spark, "live-index"), fanout=3)
    for part in range(2):
        index.put(products.where(F.col("id") % 2 == part), ("products", part))
    index.remove(products.where("id % 7 = 0").select("id"))
    index.put(products.where("id % 9 = 0 and id % 7 <> 0").withColumn("adresse", F.concat("adresse", F.lit(" neuf"))))
    return index.search(view(spark, sf_dir, "typed"))


def misspelled_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts with mistakes, through a saved index."""
    folder = new_folder(spark, "saved-spelling")
    build_spelling(build_index(view(spark, sf_dir, "products"))).save(folder)
    return misspelled_search(view(spark, sf_dir, "misspelled"), load_spelling(spark, folder))


def misspelled_search_two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts that match names and addresses, the way that a search takes where nothing can be broadcast."""
    return misspelled_search(view(spark, sf_dir, "asked"), build_spelling(build_index(view(spark, sf_dir, "streets"))), limit=0)


def choose_and_write_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two texts are typed for each row; the better result is written."""
    typed = view(spark, sf_dir, "typed").withColumn("qid", F.expr("qid div 2"))
    products = view(spark, sf_dir, "products").selectExpr("id", "nom as Nom", "adresse as Adresse", "cast(id as string) as SIRET")
    target = typed.selectExpr("qid as id", "'' as SIRET", "'' as RaisonSociale", "'' as AdresseNormalisee").distinct()
    return write_best(target, search_table(typed, products, k=1))


def choose_and_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each typed product name is looked up among the products; the best result is written into the row."""
    typed = view(spark, sf_dir, "typed")
    products = view(spark, sf_dir, "products").selectExpr("id", "nom as Nom", "adresse as Adresse", "cast(id as string) as SIRET")
    target = typed.selectExpr("qid as id", "text", "'' as SIRET", "'' as RaisonSociale", "'' as AdresseNormalisee")
    return write_best(target, search_table(typed, products, k=1))


def geocode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geocoded_columns(geocode_table(view(spark, sf_dir, "places"), view(spark, sf_dir, "gazetteer")))


def geocode_join_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geocoded_columns(geocode_table(view(spark, sf_dir, "places"), view(spark, sf_dir, "gazetteer"), limit=0))


def geocoded_columns(table: DataFrame) -> DataFrame:
    numbers = {name: F.col(name).try_cast("double") for name in ("Longitude", "Latitude")}
    return table.select("id", "Longitude", "Latitude", "GeocodedAddress").withColumns(numbers)


def geocode_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record changes twice, the second time to what it is now; coordinates of some are then given by hand."""
    folder, places = new_folder(spark, "geocoding"), view(spark, sf_dir, "places")
    now = places.withColumn("step", F.lit(2))
    for part in (now.withColumns({"step": F.lit(1), "Address": F.concat(F.lit("avant "), "Address")}), now.where("id % 2 = 0"), now.where("id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/changes")
    changes = read_changes(spark, f"{folder}/changes", now.schema, files_per_batch=1)
    gazetteer = view(spark, sf_dir, "gazetteer")
    geocode_stream(changes, gazetteer, f"{folder}/answers", f"{folder}/checkpoint", order=["step"]).awaitTermination()
    by_hand = {"Longitude": F.lit("99"), "Latitude": F.lit("88"), "GeocodedAddress": F.col("Address")}
    edited = places.withColumns({name: F.when(F.col("id") % 10 == 0, value).otherwise(F.col(name)) for name, value in by_hand.items()})
    return geocoded_columns(with_answers(edited, read_answers(spark, f"{folder}/answers")))


def rounded(cells: DataFrame) -> DataFrame:
    return cells.withColumns({name: F.round(name, DEGREES) for name in ("lat", "lng")})


def cluster_points_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster_points(map_points(view(spark, sf_dir, "places")), range(SINGLE_FROM + 1), selected=SELECTED))


def cluster_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points move, go and come in two batches, of which the first is brought in twice."""
    points = map_points(view(spark, sf_dir, "places")).select("id", "lat", "lng")
    flagged = lambda df: df.withColumn("selected", F.expr("id % 1000000 = 7 or id % 10 = 0"))
    pyramid = Pyramid.create(flagged(points), new_folder(spark, "pyramid"))
    gone = points.where("id % 7 = 0").select("id", F.lit(None).cast("double").alias("lat"), "lng")
    moved = points.where("id % 5 = 0 and id % 7 <> 0").withColumn("lat", F.col("lat") / 2)
    come = points.where("id % 11 = 0").select((F.col("id") + 1000000).alias("id"), "lat", (F.col("lng") / 2).alias("lng"))
    for number, batch in ((0, gone.unionByName(come)), (0, gone), (1, moved)):
        pyramid.apply(flagged(batch), ["lng"], ("map", number))
    return rounded(pyramid.read())


def cluster_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cluster_points(map_points(view(spark, sf_dir, "places")))
    return cells.where(F.col("n") > 1).select("zoom", "cx", "cy", "min_lat", "min_lng", "max_lat", "max_lng")


def selected_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_debt = read(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))
    cells = cluster_points(map_points(view(spark, sf_dir, "places")), selected=in_debt)
    return cells.select("zoom", "cx", "cy", "n", "has_selected")


def selected_in_cluster_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_debt = read(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))
    cells = cluster_points(map_points(view(spark, sf_dir, "places")), selected=in_debt, limit=0)
    return cells.select("zoom", "cx", "cy", "n", "has_selected")


def bounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_zoom(bounds(map_points(view(spark, sf_dir, "places"))), 1280, 800)


def last_marker_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "event_id", "value")
    return last_per_id(events, ["ts", "event_id"])


def first_match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return first_match(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def assign_ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_ids(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"])


def normalize_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", normalize_index("text").alias("text"))


def normalize_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal_rows(view(spark, sf_dir, "scripts")).select("id", normalize_index("text").alias("text"))


def normalize_query_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", normalize_query("text").alias("text"))


def build_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = join_filled("numeroVoieEtablissement", "typeVoieEtablissement", "libelleVoieEtablissement")
    return view(spark, sf_dir, "establishment").select("siret", address.alias("adresse"))


def pick_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = first_filled("enseigne1Etablissement", "denominationUniteLegale")
    return view(spark, sf_dir, "establishment").select("siret", name.alias("nom"), first_filled("libelleCommuneEtablissement").alias("commune"))


def search_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["denominationUniteLegale", "libelleVoieEtablissement", "libelleCommuneEtablissement"]
    rows = deal_rows(view(spark, sf_dir, "establishment").select("siret", *parts))
    return rows.select("siret", search_text(*parts).alias("search"))


def parse_diff_cell_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "diff_cells").select("event_id", parse_diff_cell("cell").alias("value"))


def file_name_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", file_name_from_url("url").alias("file_name"))


def size_class_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.withColumn("size_class", size_class("n"))


def marker_layer_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers(map_points(view(spark, sf_dir, "places")), SELECTED).select("id", "layer")


def label_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "places").withColumn("Name", F.expr("if(id % 3 = 0, null, Name)"))
    return markers(map_points(named)).select("id", "label")


def debounce_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounce(read(spark, sf_dir, "events"), "user_id", "ts", "event_type", GAP, order=["event_id"])


def debounce_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a sixth of the time each, some after later ones; the bursts still open at the end are added."""
    folder, events = new_folder(spark, "events"), read(spark, sf_dir, "events")
    start, end = events.agg(F.min("ts"), F.max("ts")).first()
    sixth = (end - start) / 6
    for part in (0, 2, 1, 3, 5, 4):
        inside = (F.col("ts") >= start + part * sixth) & (F.col("ts") < start + (part + 1) * sixth)
        events.where(inside | (F.col("ts") == end) & F.lit(part == 5)).coalesce(1).write.mode("append").parquet(folder)
    delay = f"{int(2 * sixth.total_seconds()) + 1} seconds"
    changes = read_changes(spark, folder, events.schema, files_per_batch=1)
    written = run_stream(debounce_stream(changes, "user_id", "ts", "event_type", delay, GAP, order=["event_id"]))
    return written.unionByName(open_bursts(events, written, "user_id", "ts", "event_type", GAP, order=["event_id"]))


def debounce_late_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a sixth of the time each, some so long after later ones that part of their inputs are late; the bursts that
    the stream has written, and what was late.
    """
    folder, events = new_folder(spark, "events"), read(spark, sf_dir, "events")
    start, end = events.agg(F.min("ts"), F.max("ts")).first()
    sixth = (end - start) / 6
    for part in (0, 2, 1, 3, 5, 4):
        inside = (F.col("ts") >= start + part * sixth) & (F.col("ts") < start + (part + 1) * sixth)
        events.where(inside | (F.col("ts") == end) & F.lit(part == 5)).coalesce(1).write.mode("append").parquet(folder)
    changes, path = read_changes(spark, folder, events.schema, files_per_batch=1), new_folder(spark, "bursts")
    delay = f"{int(sixth.total_seconds() * 1.5)} seconds"
    debounce_batches(changes, path, f"{path}/checkpoint", "user_id", "ts", "event_type", delay, GAP, ["event_id"]).awaitTermination()
    columns = ["user_id", "ts", "event_type"]
    return read_bursts(spark, path).select(*columns, F.lit(False).alias("late")).unionByName(read_late(spark, path).select(*columns, F.lit(True).alias("late")))


QUERIES = {
    "register_build": register_build,
    "scan_register_csv": scan_register_csv,
    "scan_register_csv_orders": scan_register_csv_orders,
    "scan_register_parquet": scan_register_parquet,
    "columns_to_rows": columns_to_rows_query,
    "flatten_company_response": flatten_company_response,
    "pick_snapshot_resource": pick_snapshot_resource,
    "scan_table": scan_table_query,
    "stream_records": stream_records,
    "export_register_json": export_register_json,
    "export_register_json_text": export_register_json_text,
    "update_by_id": update_by_id_query,
    "update_by_id_shuffled": update_by_id_shuffled,
    "update_versions": update_versions,
    "row_counts": row_counts,
    "rename_columns": rename_columns_query,
    "map_columns": map_columns_query,
    "check_columns": check_columns_query,
    "project_register": project_register_query,
    "prepare_searchable": prepare_searchable_query,
    "map_info": map_info_query,
    "filter_postal_prefix": filter_postal_prefix,
    "filter_active": filter_active_query,
    "filter_valid_points": filter_valid_points,
    "geocode_candidates": geocode_candidates_query,
    "filter_short_queries": filter_short_queries_query,
    "single_record": single_record,
    "fuzzy_search_topk": fuzzy_search_topk,
    "fuzzy_search_two_fields": fuzzy_search_two_fields,
    "fuzzy_search_saved_index": fuzzy_search_saved_index,
    "fuzzy_search_by_place": fuzzy_search_by_place,
    "fuzzy_search_shuffled": fuzzy_search_shuffled,
    "live_index_search": live_index_search,
    "misspelled_search": misspelled_search_query,
    "misspelled_search_two_fields": misspelled_search_two_fields,
    "choose_and_write": choose_and_write,
    "choose_and_write_repeated": choose_and_write_repeated,
    "geocode_join": geocode_join,
    "geocode_join_shuffled": geocode_join_shuffled,
    "selected_in_cluster": selected_in_cluster,
    "selected_in_cluster_shuffled": selected_in_cluster_shuffled,
    "cluster_points": cluster_points_query,
    "bounds": bounds_query,
    "cluster_changes": cluster_changes,
    "cluster_coverage": cluster_coverage,
    "last_marker_per_id": last_marker_per_id,
    "first_match": first_match_query,
    "assign_ids": assign_ids_query,
    "normalize_index": normalize_index_query,
    "normalize_scripts": normalize_scripts,
    "normalize_query": normalize_query_query,
    "build_address": build_address,
    "pick_name": pick_name,
    "search_text": search_text_query,
    "parse_diff_cell": parse_diff_cell_query,
    "unified_result": unified_result_query,
    "file_name_from_url": file_name_query,
    "size_class": size_class_query,
    "marker_layer": marker_layer_query,
    "label_text": label_text_query,
    "debounce": debounce_query,
    "debounce_stream": debounce_stream_query,
    "debounce_late": debounce_late_query,
    "geocode_stream": geocode_stream_query,
}

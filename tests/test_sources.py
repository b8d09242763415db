import json

import pytest
from pyspark.sql import functions as F

from arealis import presets as P
from arealis.operators import keys as K
from arealis.operators import ledger as L
from arealis.operators import quality as Q
from arealis.sources import cells as C
from arealis.sources import files as S
from arealis.sources import infer as IN
from arealis.sources import lines as LN


def xwalk(spark):
    rows = [("K1", "Nairobi", "nairobi", "S1", "Westlands", "westlands"), ("K1", "Nairobi", "nairobi", "S2", "Nairobi", "nairobi"),
            ("K2", "Tana River", "tana river", "S3", "Bura", "bura")]
    return spark.createDataFrame(rows, "county_code string, county_name string, county_norm string, subcounty_code string, "
                                       "subcounty_name string, subcounty_norm string")


def cell_table(spark, grid, doc="d", page=1):
    rows = [(doc, page, 0, i, j, x) for i, r in enumerate(grid) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "doc_id string, page int, table_no int, row_no int, col_no int, text string")


def test_indicator_files(spark, tmp_path):
    obs = [{"indicator": {"id": "B", "value": "b"}, "country": {"id": "KE"}, "date": "2020", "value": 1.5},
           {"indicator": {"id": "A", "value": "a"}, "country": {"id": "KE"}, "date": "2019", "value": None}]
    (tmp_path / "ok.json").write_text(json.dumps([{"page": 1}, obs], indent=1))
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "short.json").write_text("[{}]")
    assert [tuple(r) for r in S.indicator_panel(spark, str(tmp_path)).collect()] == [("B", "b", "KE", 2020, 1.5)]


def test_domains_are_united_and_tagged(spark, tmp_path):
    (tmp_path / "trade.csv").write_text("Area Code,Year,Value\n114,2020,1\n5,2020,9\n")
    (tmp_path / "crops.csv").write_text("Area Code,Item,Value\n114,maize,2\n")
    (tmp_path / "none.csv").write_text("x\n1\n")
    df = S.union_domains({p.stem: S.read_table(spark, str(p)) for p in tmp_path.glob("*.csv")}, 114)
    assert {(r.domain, r.Value, r.Year, r.Item) for r in df.collect()} == {("trade", "1", "2020", None), ("crops", "2", None, "maize")}


def test_drop_folder_routes_and_joins(spark, tmp_path):
    for name in ("soilhive", "fortification", "skipme"):
        (tmp_path / "external" / name).mkdir(parents=True)
    (tmp_path / "external/soilhive/My file.csv").write_text("place,v\n#adm,#v\nNairobi,1\nTana-River,2\n")
    (tmp_path / "external/fortification/f.csv").write_text("v\n1\n")
    (tmp_path / "external/skipme/f.csv").write_text("v\n1\n")
    layers = {"soil_hive_data": "soil", "fortification_refs": "food"}
    got = S.ingest_folder(spark, str(tmp_path / "external"), str(tmp_path / "out"), layers, xwalk(spark), ("skipme",))
    assert {(layer, table) for layer, table, _ in got} == {("soil", "soilhive__my_file"), ("food", "fortification__f")}
    soil = spark.read.parquet(next(p for layer, _, p in got if layer == "soil"))
    assert {(r.place, r.county_code) for r in soil.collect()} == {("Nairobi", "K1"), ("Tana-River", "K2")}
    (tmp_path / "external/fortification/g.csv").write_text("v,w\n2,3\n")
    both = S.folder_table(spark, [str(tmp_path / "absent"), str(tmp_path / "external/fortification")])
    assert {tuple(r) for r in both.collect()} == {("1", "f.csv", None), ("2", "g.csv", "3")}
    names = spark.createDataFrame([("unknown",), ("Soil-Hive",), ("fort",), ("soil hive data 2",)], "source string")
    registry = spark.createDataFrame([*layers.items(), ("soil", "other")], "key string, layer string")
    assert {tuple(r) for r in S.route_layers(names, registry).collect()} == {
        ("unknown", "core"), ("Soil-Hive", "soil"), ("fort", "food"), ("soil hive data 2", "soil")}


def test_jobs_of_a_drop_folder_follow_headers_not_files(spark, tmp_path):
    def jobs(files):
        root = tmp_path / f"d{files}"
        for k in range(files):
            (root / f"src{k % 3}").mkdir(parents=True, exist_ok=True)
            text = ["place,v\n#adm,#v\nNairobi,{0}\n", "table,place,v\nx,Tana River,{0}\n#a,#b,#c\n", "a b,c\n{0},2\n"][k % 3]
            (root / f"src{k % 3}/File {k:02d}+%.csv").write_text(text.format(k))
        (root / "src0/none.csv").write_text("")
        spark.sparkContext.setJobGroup(str(files), "")
        got = S.ingest_folder(spark, str(root), str(tmp_path / f"o{files}"), {"src1": "soil"}, xwalk(spark))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(files)))

    (few, n_few), (many, n_many) = jobs(3), jobs(30)
    assert len(few) == 3 and len(many) == 30 and n_many <= 1.25 * n_few
    read = {t: [r.asDict() for r in spark.read.parquet(p).collect()] for _, t, p in many}
    assert read["src0__file_00"] == [{"place": "Nairobi", "v": "0", "county_code": "K1", "county_name": "Nairobi"}]
    assert {r["place"]: r["county_code"] for r in read["src1__file_04"]} == {"Tana River": "K2", "#b": None}  # tags come second
    assert all("table_" in r for r in read["src1__file_04"]) and read["src2__file_29"] == [{"a b": "29", "c": "2"}]
    assert {(layer, t) for layer, t, _ in few} == {("core", "src0__file_00"), ("soil", "src1__file_01"), ("core", "src2__file_02")}
    both = S.folder_table(spark, [str(tmp_path / "d30/src2")])
    assert {r.file for r in both.collect()} == {f"File {k:02d}+%.csv" for k in range(2, 30, 3)}


def test_only_a_first_record_of_tags_goes(spark):
    df = spark.createDataFrame([(0, "a", "#x"), (1, "#y", "#z")], "at int, p string, q string")
    assert S.strip_tag_row(df, "at").count() == 2
    assert [r.at for r in S.strip_tag_row(df.where("at = 1"), "at").collect()] == []


def test_rows_by_name_and_section(spark):
    grid = [["Table 1", None, None, None], ["County", "Total", "Male", "Female"], ["Nairobi", "1,000", "400", "600"],
            ["Westlands", "10", "4", "6"], ["Nairobi", "5", "1", "4"], ["Nowhere", "1", "1", "0"], ["Bura", None, "-", ""]]
    area, sub = C.classify_rows(cell_table(spark, grid), xwalk(spark))
    assert [(r.county_norm, r.population_total, r.population_female, r.county_code) for r in area.collect()] == [("nairobi", 1000.0, 600.0, "K1")]
    assert [(r.subcounty_norm, r.population_male) for r in sub.collect()] == [("westlands", 4.0)]
    grid = [["County", "Agricultural land", "", "Households"], ["", "Subsistence", "Commercial", ""], ["Whole land", "9", "9", "9"],
            ["Nairobi", "1", "2", "3"], ["Nairobi", "4", "5", "6"], ["Tana River", "7", "8", "9"], ["Nairobi", "0", "0", "0"]]
    area, sub = C.sectioned_table(cell_table(spark, grid), xwalk(spark), ("whole land",))
    assert {(r.county_norm, r.ag_land_ha_subsistence, r.farming_households_total) for r in area.collect()} == {
        ("nairobi", 1.0, 3.0), ("tana river", 7.0, 9.0)}
    assert {(r.subcounty_norm, r.ag_land_ha_commercial, r.subcounty_code) for r in sub.collect()} == {("nairobi", 5.0, "S2")}


def test_header_words_in_order(spark):
    grid = [["x"]] * 30 + [["Sub-County", "County", "Female", "Male", "Total"]]  # however far down
    got = C.map_header_columns(cell_table(spark, grid)).collect()
    assert {r.col_no: r.canon for r in got} == {
        0: "subcounty", 1: "county", 2: "population_female", 3: "population_male", 4: "population_total"}
    assert {r.header_row for r in got} == {30}
    assert C.header_row(cell_table(spark, grid)).first().header_row == 30


def test_department_rows_carry_headings(spark):
    cells = cell_table(spark, [["Agriculture", "2,500,000", "1 3"], ["Agriculture", "9", "9"]], page=2)
    texts = spark.createDataFrame([("d", 1, "3.1 Tana River County"), ("d", 2, "continued")], "doc_id string, page int, text string")
    assert [tuple(r) for r in C.department_rows(cells, texts).collect()] == [("d", "Tana River", 2.5, 1.0)]


def test_text_lines(spark):
    rows = ["Name Male Female Total", "Tana River 1 2 3", "Nairobi 4 5 6", "Bura 7 8 9", "Bura 1 1 1", "Nairobi 1 2 3 4 5", "Tana 1 2 3"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(rows)], "doc_id string, line_no bigint, text string")
    w = xwalk(spark)
    out = LN.parse_lines(lines, w, w)
    def values(df, key, column):
        return {(r[key], r.value) for r in df.collect() if r.column == column}

    assert values(out["county_norm"], "county_norm", "population_total") == {("tana river", 3.0)}
    assert values(out["subcounty_norm"], "subcounty_norm", "population_male") == {("nairobi", 4.0), ("bura", 7.0)}
    area_first = LN.parse_lines(lines, w, w, subarea_wins=False)
    assert values(area_first["county_norm"], "county_norm", "population_male") == {("tana river", 1.0), ("nairobi", 4.0)}


def test_every_text_has_its_own_width_and_names_may_be_long(spark):
    keys = spark.createDataFrame([(f"area {x}",) for x in "abcdefg"] + [("a name of four",)], "county_norm string")
    none = keys.where("false").select(F.col("county_norm").alias("subcounty_norm"))
    rows = [("a", i, f"Area {x} 1 2 3") for i, x in enumerate("abcd")]
    rows += [("b", 0, "Male Female Total Households Density")] + [("b", i, f"Area {x} 1 2 3 4 5") for i, x in enumerate("efg", 1)]
    lines = spark.createDataFrame([*rows, ("c", 0, "A name of four 1 2 3")], "doc_id string, line_no bigint, text string")
    out = LN.parse_lines(lines, keys, none)["county_norm"].collect()
    assert {(r.doc_id, r.county_norm) for r in out} == {(d, f"area {x}") for d, xs in (("a", "abcd"), ("b", "efg")) for x in xs} | {
        ("c", "a name of four")}
    assert {r.column for r in out if r.doc_id == "b"} == {"population_male", "population_female", "population_total",
                                                          "households", "density"}


def test_crosswalk_seed_and_detection(spark):
    seed = K.build_crosswalk(spark)
    assert seed.count() == 47 and seed.where("county_norm = 'murang a'").first().county_code == "KE21"
    assert K.area_frame(None, spark).count() == 47
    assert {r.county_norm for r in K.area_frame(xwalk(spark), spark).collect()} == {"nairobi", "tana river"}
    df = spark.createDataFrame([("x", "Nairobi"), ("y", "Bura"), ("z", "q")], "a string, b string")
    assert K.detect_key_column(df, xwalk(spark)) == "b"
    assert K.detect_key_column(df.select("a"), xwalk(spark)) is None
    many = spark.createDataFrame([(f"n{i}", "Nairobi" if i < 20 else f"v{i}") for i in range(900)], "a string, b string")
    assert K.detect_key_column(many, xwalk(spark)) is None  # 20 chance hits
    found = {role: K.match_column(["ADM1_EN", "ADM1_PCODE", "ADM2_EN", "x"], p) for role, p in P.BOUNDARY_COLUMNS.items()}
    assert found == {"area_name": "ADM1_EN", "area_code": "ADM1_PCODE", "subarea_name": "ADM2_EN", "subarea_code": None}
    assert K.match_alias(["GPS_Latitude", "m3-P"], ("lat", "latitude")) == "GPS_Latitude"
    assert S.point_columns(["Lat", "Long", "M3.P", "Zinc"])[2] == {"P": "M3.P", "Zn": "Zinc"}
    stems = spark.createDataFrame([("isda_iron_extractable",), ("bulk-density",), ("x isda",)], "stem string")
    assert {r.column for r in S.raster_columns(stems).collect()} == {"fe_isda", "bulk_density_isda", "x_isda"}


def test_ledger_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    base = {"source_key": "k", "layer": "food", "csv_outputs": ["x"], "verification_anchors": 3, "anchors_missing": ["m"], "pages": 7}
    (tmp_path / "a/1_provenance.json").write_text(json.dumps({**base, "sha256": "abc"}, indent=2))
    (tmp_path / "a/2_provenance.json").write_text(json.dumps(base, indent=2))
    rows = L.sidecar_rows(L.read_sidecars(spark, str(tmp_path / "a"))).collect()
    assert [(r.source_key, r.status, r.message) for r in rows] == [
        ("k", "manual", "local extract: 7 pages, 1 CSV tables, anchors 2/3 verified")]
    old = L.ledger_rows(spark, [{"source_key": "k", "status": "failed"}, {"source_key": "j", "status": "ok"}])
    L.append(L.upsert(old, L.sidecar_rows(L.read_sidecars(spark, str(tmp_path / "a")))), str(tmp_path / "ledger"))
    assert {(r.source_key, r.status) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()} == {("k", "manual"), ("j", "ok")}
    with pytest.raises(ValueError):
        L.ledger_rows(spark, [{"status": "maybe"}])
    reg = L.flatten_registry(spark, {"food": {"k": {"title": "T", "api": "http://x", "access": "open_api"}}})
    assert reg.first().url == "http://x"
    inv = Q.inventory_summary(Q.file_inventory(spark, str(tmp_path / "a"))).first()
    assert inv.n_files == 2 and inv.largest.endswith("1_provenance.json")
    L.publish(reg, str(tmp_path / "csv"), "csv")
    assert S.read_table(spark, str(tmp_path / "csv")).count() == 1
    seed = spark.createDataFrame([("s",)], "county string")
    assert L.seed_or_override(spark, str(tmp_path / "absent"), seed).first().county == "s"


def test_area_table_from_layers(spark):
    from arealis.plans.area_table import build_area_table

    pop = spark.createDataFrame([("K1", 100.0, 20.0), ("K2", 0.0, 10.0), ("K2", 5.0, 1.0)], "county_code string, population_total double, households double")
    crops = spark.createDataFrame([("K1", "maize", 2020, 2.0, 8.0), ("K2", "beans", 2019, 1.0, 1.0)],
                                  "county_code string, crop string, year int, area_ha double, production_mt double")
    nut = spark.createDataFrame([("K1", 30.0), ("K2", 10.0)], "county_code string, stunting double")
    out = {r.county_code: r for r in build_area_table({"crosswalk": xwalk(spark), "population": pop, "crops": crops, "nutrition": nut}).collect()}
    assert len(out) == 2 and out["K1"].maize_yield_t_ha == 4.0 and out["K1"].crop_production_per_capita_kg == 80.0
    assert out["K2"].maize_yield_t_ha is None and out["K1"].gap_body_stunting == 10.0


def test_declared_readiness_of_the_layers(spark):
    def rows(n, **columns):
        return spark.range(n).select("id", *[F.lit(v).alias(c) for c, v in columns.items()])

    def graded(layer, tables):
        return {r.label: r.status for r in Q.readiness(tables, P.READINESS[layer], layer, spark).collect()}

    got = graded("geography", {"crosswalk_admin": spark.range(290).select((F.col("id") % 47).alias("county_norm")),
                               "census_population_county": rows(46), "remote_sensing_county": rows(47, ndvi_mean=1.0)})
    assert got["crosswalk_admin"] == got["crosswalk_admin.county_norm distinct"] == "PASS"
    assert got["census_population_county"] == "WARN" and got["census_agriculture_county"] == "FAIL"
    assert got["remote_sensing_county.ndvi_mean"] == "PASS" and got["remote_sensing_county.drought_freq"] == "WARN"
    isda = rows(47, p_isda=1, k_isda=1, zn_isda=1)
    got = graded("soil", {"soilgrids_zonal_county": rows(47, **{"soc_0-5cm_mean": 1, "Nitrogen_x": 1, "cec": 1}), "isda_county": isda})
    assert got["soilgrids_zonal_county"] == "PASS" and got["isda_county.fe_isda"] == "FAIL"
    assert got["afsis_county"] == "WARN" and got["soil index inputs"] == "WARN"
    got = graded("food", {"napr_crop_county": rows(20, crop="maize"), "kfct_minerals": rows(3), "faostat_kenya": rows(1)})
    assert got["faostat_kenya"] == got["food density inputs"] == "PASS" and got["napr_crop_county.crop distinct"] == "WARN"
    assert got["kfct_foods"] == "FAIL" and got["prices_wb_modeled"] == "INFO"
    got = graded("health", {"kdhs_county": rows(47, stunting=1.0, wasting=None), "kdhs_controls_county": rows(47, mdd=1)})
    assert got["kdhs_county.stunting"] == "PASS" and got["kdhs_controls_county columns"] == got["trend inputs"] == "WARN"
    assert got["kdhs_county.wasting"] == got["kdhs_county.underweight"] == "FAIL" and got["kdhs_gps_clusters"] == "INFO"
    plan = {f"action_plan__{i}": rows(1) for i in range(10)}
    got = graded("policy", {**plan, "policy_county_summary": rows(40, policy_signal_index=1.0)})
    assert got["Action Plan tables"] == "PASS" and got["policy_county_summary"] == got["policy_county_summary columns"] == "WARN"
    assert got["policy_panel"] == "FAIL"


def test_types_of_text_columns(spark):
    rows = [("1", "2.5", "2020-01-31", "x", None, " "), ("-7", "1e3", "2020-02-29", "1", "NA", "12"), (None, "3", None, "2", "", "2020-01-01")]
    df = spark.createDataFrame(rows, "whole string, `re al` string, day string, text string, none string, mixed string")
    got = {r.column: (r.type, r.n_filled) for r in IN.column_types(df).collect()}
    assert got == {"whole": ("long", 2), "re al": ("double", 3), "day": ("date", 2), "text": ("string", 3), "none": ("null", 0), "mixed": ("string", 2)}
    read = IN.read_inferred(df)
    assert [f.dataType.simpleString() for f in read.schema] == ["bigint", "double", "date", "string", "string", "string"]
    assert [r["re al"] for r in read.collect()] == [2.5, 1000.0, 3.0] and read.collect()[1].none is None
    assert {r.type for r in IN.column_types(df.limit(0)).collect()} == {"null"}

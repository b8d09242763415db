"""Code lists, word lists, constants and model specifications."""

from __future__ import annotations

# --- area list used where no boundary table is at hand (code, name) -------------------
SEED_AREAS = [
    (1, "Mombasa"), (2, "Kwale"), (3, "Kilifi"), (4, "Tana River"), (5, "Lamu"),
    (6, "Taita Taveta"), (7, "Garissa"), (8, "Wajir"), (9, "Mandera"), (10, "Marsabit"),
    (11, "Isiolo"), (12, "Meru"), (13, "Tharaka Nithi"), (14, "Embu"), (15, "Kitui"),
    (16, "Machakos"), (17, "Makueni"), (18, "Nyandarua"), (19, "Nyeri"), (20, "Kirinyaga"),
    (21, "Murang'a"), (22, "Kiambu"), (23, "Turkana"), (24, "West Pokot"), (25, "Samburu"),
    (26, "Trans Nzoia"), (27, "Uasin Gishu"), (28, "Elgeyo Marakwet"), (29, "Nandi"),
    (30, "Baringo"), (31, "Laikipia"), (32, "Nakuru"), (33, "Narok"), (34, "Kajiado"),
    (35, "Kericho"), (36, "Bomet"), (37, "Kakamega"), (38, "Vihiga"), (39, "Bungoma"),
    (40, "Busia"), (41, "Siaya"), (42, "Kisumu"), (43, "Homa Bay"), (44, "Migori"),
    (45, "Kisii"), (46, "Nyamira"), (47, "Nairobi"),
]
AREA_CODE_FORMAT = "KE%02d"
EXPECTED_AREAS, EXPECTED_SUBAREAS = 47, 290
AREA_BAND, SUBAREA_BAND = (40, 60), (240, 340)
LAYERS = ("geography", "soil", "food", "health", "policy", "core")

# --- soil -----------------------------------------------------------------------------
# Divisor from stored to conventional units.
SOIL_DIVISORS = {
    "phh2o": 10, "soc": 10, "nitrogen": 100, "cec": 10, "bdod": 100, "cfvo": 10,
    "clay": 10, "sand": 10, "silt": 10,
}
TOPSOIL_WEIGHTS = {"0-5cm": 5, "5-15cm": 10, "15-30cm": 15}
DEPTH_COLUMN = r"^([a-z0-9]+)_(\d+-\d+cm)_mean$"
SOIL_INDEX_COLUMNS = ("soc", "nitrogen", "cec", "p_isda", "k_isda", "zn_isda", "fe_isda")
TYPOLOGY_COLUMNS = (*SOIL_DIVISORS, "p_isda", "k_isda", "zn_isda", "fe_isda")
RASTER_NAMES = {
    "phosphorus_extractable": "p_isda", "potassium_extractable": "k_isda",
    "zinc_extractable": "zn_isda", "iron_extractable": "fe_isda",
    "calcium_extractable": "ca_isda", "magnesium_extractable": "mg_isda",
    "sulphur_extractable": "s_isda", "nitrogen_total": "n_isda",
    "carbon_organic": "soc_isda", "ph": "ph_isda",
}
NUTRIENT_ALIASES = {
    "P": ("p", "phosphorus", "mehlichp", "m3p", "pppm", "extractablep"),
    "K": ("k", "potassium", "mehlichk", "m3k", "kppm"),
    "Zn": ("zn", "zinc"), "Fe": ("fe", "iron"), "Ca": ("ca", "calcium"),
    "Mg": ("mg", "magnesium"), "S": ("s", "sulphur", "sulfur"), "Cu": ("cu", "copper"),
    "Mn": ("mn", "manganese"), "B": ("b", "boron"),
}
LAT_ALIASES = ("lat", "latitude", "ycoord", "gpslat", "ylat", "y")
LON_ALIASES = ("lon", "long", "longitude", "xcoord", "gpslon", "xlon", "x")

# --- survey microdata -----------------------------------------------------------------
WEIGHT_SCALE = 1_000_000.0
Z_LIMIT, Z_CUT = 600, -200
AREA_VARIABLES = ("v024", "shcounty", "scounty", "county", "hv024", "sdistrict", "sdist")
MIN_LABEL_HITS = 20
DIET_GROUPS = {
    "breastmilk": ("v404",),
    "grains_roots": ("v414e", "v414f", "v412a"),
    "legumes_nuts": ("v414o",),
    "dairy": ("v411", "v411a", "v414p"),
    "flesh_foods": ("v414h", "v414m", "v414n"),
    "eggs": ("v414g",),
    "vita_fruit_veg": ("v414i", "v414j", "v414k"),
    "other_fruit_veg": ("v414l",),
}
IMPROVED_WATER = (11, 12, 13, 14, 21, 31, 41, 51, 71, 72, 91, 92)
IMPROVED_SANITATION = (11, 12, 13, 14, 15, 21, 22, 41)

# --- food -----------------------------------------------------------------------------
NUTRIENTS = {
    "energy_kcal": "energy_kcal", "protein_g": "protein_g", "iron_mg": "fe_mg",
    "zinc_mg": "zn_mg", "vita_rae_mcg": "vit_a_rae_mcg", "folate_mcg": "folate_dfe_mcg",
    "calcium_mg": "ca_mg",
}
PER_CAPITA_NAMES = {
    "energy_kcal": "food_kcal_pc_day", "protein_g": "food_protein_g_pc_day",
    "iron_mg": "food_iron_mg_pc_day", "zinc_mg": "food_zinc_mg_pc_day",
    "vita_rae_mcg": "food_vita_rae_pc_day", "folate_mcg": "food_folate_pc_day",
    "calcium_mg": "food_calcium_mg_pc_day",
}
DENSITY_NUTRIENTS = ("protein_g", "iron_mg", "zinc_mg", "vita_rae_mcg", "folate_mcg", "calcium_mg")
# item key -> (any of these words, none of these words)
FOOD_RULES = {
    "maize": (("maize",), ("flour", "green", "baby", "starch")),
    "beans": (("bean",), ("green", "leaf", "flour")),
    "irishpotatoes": (("potato",), ("sweet", "crisp", "chip")),
    "potatoes": (("potato",), ("sweet", "crisp", "chip")),
    "sweetpotatoes": (("sweetpotato",), ("leaf",)),
    "sorghum": (("sorghum",), ("flour",)),
    "millet": (("millet",), ("flour",)),
    "fingermillet": (("millet",), ("flour",)),
    "pearlmillet": (("millet",), ("flour",)),
    "rice": (("rice",), ("flour",)),
    "wheat": (("wheat",), ("flour", "bread", "bran")),
    "greengrams": (("greengram", "mung"), ("flour",)),
    "cowpeas": (("cowpea",), ("leaf",)),
    "pigeonpeas": (("pigeonpea", "pigeon"), ()),
    "cassava": (("cassava",), ("flour", "leaf")),
    "bananas": (("banana",), ("juice", "ripe")),
    "groundnuts": (("groundnut", "peanut"), ("butter", "oil")),
    "soybeans": (("soya", "soybean"), ("oil", "sauce")),
    "barley": (("barley",), ("flour",)),
}
PREFERRED_WORDS = ("raw", "dried", "dry", "whole", "grain", "mature", "wholemeal")
PROCESSED_WORDS = ("cooked", "boiled", "fried", "roasted", "juice", "leaf", "canned")
COMPOSITION_BLOCKS = {
    "proximates": {
        "detect": ("energy", "protein", "water"),
        "cols": ("edible_factor", "energy_kj", "energy_kcal", "water_g", "protein_g", "fat_g",
                 "carbohydrate_g", "fibre_g", "ash_g"),
    },
    "minerals": {
        "detect": ("ca", "fe", "zn", "se"),
        "cols": ("ca_mg", "fe_mg", "mg_mg", "p_mg", "k_mg", "na_mg", "zn_mg", "se_mcg"),
    },
    "vitamins": {
        "detect": ("retinol", "thiamin", "riboflavin"),
        "cols": ("vit_a_rae_mcg", "vit_a_re_mcg", "retinol_mcg", "beta_carotene_mcg",
                 "thiamin_mg", "riboflavin_mg", "niacin_mg", "folate_dfe_mcg",
                 "food_folate_mcg", "vit_b12_mcg", "vit_c_mg"),
    },
}

# --- printed census tables --------------------------------------------------------------
HEADER_WORDS = (
    ("subcounty", ("sub-county", "subcounty", "sub county")),
    ("county", ("county",)),
    ("population_total", ("total", "total population", "population")),
    ("population_male", ("male",)),
    ("population_female", ("female",)),
    ("households", ("number of households", "households", "household")),
    ("avg_household_size", ("average household size", "household size", "av. hh")),
    ("land_area_sqkm", ("land area", "area")),
    ("density", ("density", "population density")),
)
# canonical name -> words that bar it
HEADER_BARS = {"population_male": "female", "county": "sub"}
LINE_HEADER_WORDS = (
    ("population_male", ("male",)), ("population_female", ("female",)),
    ("intersex", ("intersex",)), ("population_total", ("total",)),
    ("households", ("household",)), ("avg_household_size", ("average", "mean hh", "av. hh")),
    ("land_area_sqkm", ("land area", "sq. km", "sq km", "area")), ("density", ("density",)),
)
LINE_COLUMNS = {
    8: ("population_male", "population_female", "intersex", "population_total", "households",
        "avg_household_size", "land_area_sqkm", "density"),
    7: ("population_male", "population_female", "intersex", "population_total", "households",
        "land_area_sqkm", "density"),
    6: ("population_male", "population_female", "population_total", "households",
        "land_area_sqkm", "density"),
    5: ("population_male", "population_female", "population_total", "households", "density"),
    4: ("population_total", "households", "land_area_sqkm", "density"),
    3: ("population_total", "households", "density"),
}

# --- registry and audit -----------------------------------------------------------------
OPEN_ACCESS = ("open_api", "open_download")
AREA_COLUMN_HINTS = ("county_name", "county", "adm1_en", "admin1", "name_1", "area")
STATUS_RANK = {"SKIP": 0, "INFO": 0, "PASS": 1, "WARN": 2, "FAIL": 3}

# --- model specifications: name -> (outcome, regressors) ---------------------------------
STAGE1_CONTROLS = ("ag_land_share", "farming_hh_share", "cropland_per_farming_hh_ha",
                   "crop_diversity_shannon", "rain_mm_mean", "drought_freq")
STAGE2_REGRESSORS = ("food_nutrient_density_index", "soil_index", "wealth_factor_mean",
                     "edu_years_mean", "improved_water_share", "improved_sanitation_share",
                     "diarrhea_share", "rain_mm_mean")
SPECIFICATIONS = {
    "food_density": ("food_nutrient_density_index", ("soil_index", *STAGE1_CONTROLS)),
    "nutrition": ("stunting", STAGE2_REGRESSORS),
    "policy_response": ("policy_signal_index", (
        "gap_body_stunting", "gap_food_density", "gap_soil", "maize_production_per_capita_kg",
        "maize_yield_t_ha", "density")),
    "persistence": ("stunting", (
        "stunting_2014", "food_nutrient_density_index", "soil_index", "wealth_factor_mean",
        "edu_years_mean", "improved_water_share")),
    "yield_on_soil": ("maize_yield_t_ha", ("phh2o", "soc", "nitrogen", "cec", "clay")),
    "price_on_soil": ("maize_price_median", ("phh2o", "soc", "nitrogen", "cec", "clay")),
    "nutrition_on_soil": ("stunting", (
        "phh2o", "soc", "nitrogen", "cec", "maize_price_median", "maize_yield_t_ha")),
}
SUBSAMPLE_REGRESSORS = ("food_nutrient_density_index", "soil_index", "wealth_factor_mean")
DIET_REGRESSORS = ("wealth_factor_mean", "edu_years_mean", "improved_water_share")
OUTCOME_LABELS = (("stunting", "child stunting"), ("wasting", "child wasting"),
                  ("underweight", "child underweight"), ("mdd", "dietary diversity (MDD)"))
SPATIAL_TARGETS = (("stunting", "child stunting"),
                   ("food_nutrient_density_index", "food nutrient density"),
                   ("soil_index", "soil index"),
                   ("stunting_change", "stunting change between rounds"))
ENVIRONMENT_TERMS = ("rain_mm_mean", "ndvi_mean")
CHILD_CONTROLS = ("child_age_months", "child_female", "mother_edu_years", "wealth")

# --- name patterns, in order of preference (fixed values) -------------------------------
#: Column roles of a boundary attribute table: patterns for the whole lower-case column name.
BOUNDARY_COLUMNS = {
    "area_name": (r"(?=.*adm1)(?=.*(?:en|name)).*|county|county_nam|counties",),
    "area_code": (r"(?=.*adm1)(?=.*(?:pcode|code)).*",),
    "subarea_name": (r"(?=.*adm2)(?=.*(?:en|name)).*|subcounty|sub_county|scounty|sub_count",),
    "subarea_code": (r"(?=.*adm2)(?=.*(?:pcode|code)).*",),
}
#: Measure and use of a sectioned agricultural table: (words, name); the last one holds otherwise.
SECTION_MEASURES = (("area", "ag_land_ha"), ("agricultural land", "ag_land_ha"), ("household", "farming_households"))
SECTION_USES = (("subsistence", "subsistence"), ("commercial", "commercial"), ("", "total"))
DATA_WORDS = ("population", "household", "area", "density", "male", "female", "total")
SKIP_NAMES = ("total", "source", "note", "annex")
# spending columns and the signals of the two policy indices
SPENDING_INTENSITY = ("ag_budget_alloc_kes_m", "ag_expenditure_kes_m", "ag_dev_expenditure_kes_m",
                      "ag_absorption_rate", "ag_share_of_budget", "health_expenditure_kes_m")
POLICY_SIGNALS = ("fertilizer_priority", "ag_expenditure_kes_m", "ag_absorption_rate", "ag_share_of_budget")
FOOD_SIGNALS = ("fertilizer_priority", "ag_expenditure_kes_m", "ag_dev_expenditure_kes_m")
REGISTRY_COLUMNS = ("layer", "source_key", "title", "publisher", "mirror", "access", "license", "role", "url")
URL_KEYS = ("url", "resource_url", "api", "base_url", "dataset_url", "landing")
AREA_CODE_ALIASES = ("area code", "area_code", "areacode", "area code (fao)")

# --- readiness of the five layers (fixed values: table names, columns and counts) --------
#: See ``quality.readiness`` for the fields of a rule.
READINESS = {
    "geography": (
        {"table": "crosswalk_admin", "expect": 290, "distinct": ("county_norm", 47)},
        {"table": "census_population_county", "expect": 47}, {"table": "census_agriculture_county", "expect": 47},
        {"table": "census_population_subcounty"}, {"table": "census_agriculture_subcounty"},
        {"table": "remote_sensing_county", "expect": 47, "essential": False,
         "columns": ("rain_mm_mean", "ndvi_mean", "drought_freq")},
    ),
    "soil": (
        {"table": "soilgrids_zonal_county", "expect": 47},
        {"table": "isda_county", "expect": 47, "columns": ("p_isda", "k_isda", "zn_isda", "fe_isda")},
        {"table": "afsis_county", "essential": False},
        {"label": "soil index inputs", "inputs": {"soilgrids_zonal_county": ("soc", "nitrogen", "cec"),
                                                  "isda_county": ("p_isda", "k_isda", "zn_isda", "fe_isda")}},
    ),
    "food": (
        {"table": "faostat_kenya"}, {"table": "prices_wfp_observed"},
        {"table": "napr_crop_county", "distinct": ("crop", 9)},
        {"table": "kfct_foods"}, {"table": "kfct_proximates"}, {"table": "kfct_minerals"}, {"table": "kfct_vitamins"},
        {"table": "prices_wb_modeled", "optional": True},
        {"label": "food density inputs", "inputs": {"napr_crop_county": ()},
         "one_of": ("kfct_proximates", "kfct_minerals", "kfct_vitamins")},
    ),
    "health": (
        {"table": "kdhs_county", "expect": 47, "columns": ("stunting", "wasting", "underweight")},
        {"table": "kdhs_controls_county", "expect": 47,
         "present": (("mdd", "wealth_factor_mean", "edu_years_mean", "improved_water_share", "improved_sanitation_share",
                      "diarrhea_share", "vit_a_supp_share", "maternal_bmi_mean"), 6)},
        {"table": "kdhs_county_2014", "expect": 47, "essential": False, "columns": ("stunting",)},
        {"table": "kdhs_controls_county_2014", "expect": 47, "essential": False},
        {"label": "trend inputs", "inputs": {"kdhs_county": ("stunting",), "kdhs_county_2014": ("stunting",)}},
        {"table": "wb_hnp_panel", "essential": False},
        {"table": "kdhs_gps_clusters", "optional": True}, {"table": "kdhs_gps_clusters_2014", "optional": True},
    ),
    "policy": (
        {"label": "Action Plan tables", "prefix": ("action_plan__", 10)},
        {"table": "policy_county_summary", "expect": 47, "essential": False, "columns": ("policy_signal_index",),
         "present": (("fertilizer_priority",), 1)},
        {"table": "policy_panel"},
    ),
}

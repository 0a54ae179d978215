"""Class maps, defaults, keyword lists and rule tables (output data, kept verbatim)."""

# --- fixed values: road class by highway tag -----------------------------------------------------
ROAD_CLASS = {
    "motorway": "arterial", "trunk": "arterial", "primary": "arterial",
    "secondary": "collector", "tertiary": "collector",
    "residential": "local", "service": "local", "unclassified": "local", "living_street": "local",
    "pedestrian": "pedestrian", "footway": "pedestrian", "cycleway": "cycleway", "path": "pedestrian",
}

# --- fixed values: enriched road class by highway tag (unknown -> Local) -------------------------
ROAD_CLASS_ENRICHED = {
    "motorway": "Arterial", "trunk": "Arterial", "primary": "Arterial",
    "secondary": "Coletora", "tertiary": "Coletora",
    "residential": "Local", "service": "Local", "unclassified": "Local", "living_street": "Local",
}

# --- fixed values: road category by highway tag --------------------------------------------------
ROAD_CATEGORY = {
    "motorway": "motorway", "motorway_link": "motorway", "trunk": "trunk", "trunk_link": "trunk",
    "primary": "primary", "primary_link": "primary", "secondary": "secondary", "secondary_link": "secondary",
    "tertiary": "tertiary", "tertiary_link": "tertiary", "residential": "residential",
    "living_street": "residential", "service": "residential", "unclassified": "residential",
    "road": "residential", "track": "other", "path": "other", "footway": "other", "cycleway": "other",
    "steps": "other", "pedestrian": "other", "construction": "other",
}

# --- fixed values: speed in km/h by road category (unknown -> 30) --------------------------------
SPEED_KMH = {
    "motorway": 100, "trunk": 80, "primary": 60, "secondary": 50,
    "tertiary": 40, "residential": 30, "other": 20, "unclassified": 30,
}

# --- fixed values: building class by building tag ------------------------------------------------
BUILDING_CLASS = {
    "house": "residential", "residential": "residential", "apartments": "residential",
    "detached": "residential", "semidetached_house": "residential", "terrace": "residential",
    "dormitory": "residential",
    "commercial": "commercial", "retail": "commercial", "shop": "commercial", "supermarket": "commercial",
    "department_store": "commercial", "mall": "commercial", "kiosk": "commercial",
    "industrial": "industrial", "warehouse": "industrial", "factory": "industrial", "manufacture": "industrial",
    "office": "office", "government": "office", "civic": "office",
    "school": "educational", "university": "educational", "college": "educational",
    "kindergarten": "educational", "education": "educational",
    "hospital": "healthcare", "clinic": "healthcare", "doctors": "healthcare", "dentist": "healthcare",
    "pharmacy": "healthcare",
    "church": "religious", "mosque": "religious", "temple": "religious", "synagogue": "religious",
    "shrine": "religious", "place_of_worship": "religious",
    "garage": "utility", "garages": "utility", "parking": "utility", "service": "utility", "shed": "utility",
    "storage_tank": "utility",
    "hotel": "accommodation", "hostel": "accommodation", "guest_house": "accommodation",
    "motel": "accommodation",
    "sports_centre": "leisure", "stadium": "leisure", "grandstand": "leisure", "pavilion": "leisure",
    "restaurant": "leisure", "fast_food": "leisure", "cafe": "leisure", "pub": "leisure", "bar": "leisure",
    "cinema": "leisure", "theatre": "leisure", "library": "leisure", "museum": "leisure",
    "construction": "construction", "ruins": "abandoned", "collapsed": "abandoned", "damaged": "abandoned",
}

# --- fixed values: land category by landuse tag --------------------------------------------------
LAND_CATEGORY = {
    "residential": "urban", "commercial": "urban", "retail": "urban", "industrial": "urban",
    "construction": "urban", "brownfield": "urban", "garages": "urban", "railway": "urban",
    "military": "urban",
    "education": "institutional", "government": "institutional", "governmental": "institutional",
    "institutional": "institutional", "religious": "institutional", "hospital": "institutional",
    "cemetery": "institutional",
    "recreation_ground": "green", "park": "green", "village_green": "green", "grass": "green",
    "meadow": "green",
    "orchard": "agriculture", "vineyard": "agriculture", "farmland": "agriculture", "farmyard": "agriculture",
    "forest": "forest", "quarry": "extraction", "basin": "water", "reservoir": "water",
    "allotments": "agriculture",
}

# --- fixed values: land category keywords, first hit wins ----------------------------------------
LAND_KEYWORDS = {
    "urban": ["residential", "retail", "commercial", "industrial", "construction", "garages", "parking",
              "brownfield", "landfill"],
    "green": ["grass", "meadow", "recreation_ground", "village_green", "park", "garden", "greenfield",
              "allotments", "orchard", "plant_nursery", "greenhouse_horticulture"],
    "forest": ["forest", "wood"],
    "agriculture": ["farmland", "farmyard", "farm", "aquaculture"],
    "water": ["water", "reservoir", "basin"],
    "institutional": ["education", "religious", "government", "governmental", "hospital", "institutional"],
    "extraction": ["quarry", "mining"],
    "other": ["military", "proposed", "tabacaria", "yes", "propose", "gaopão", "various"],
}

# --- fixed values: words marking a residential building ------------------------------------------
RESIDENTIAL_KEYWORDS = [
    "residencial", "residential", "house", "apartamento", "apartments", "habitacional", "dwelling", "casa",
    "moradia", "housing", "residencia", "residence", "home", "domestic", "domiciliar",
]

# --- fixed values: columns searched for residential words ----------------------------------------
RESIDENTIAL_COLUMNS = [
    "building_class_enhanced", "categoria_funcional", "building", "tipo", "type", "amenity",
    "land_category", "landuse",
]

# --- fixed values: default levels and height by building type (else 1 level, 3 m) ----------------
BUILDING_DEFAULTS = {
    "residential": (2, 6), "house": (1, 4), "apartments": (4, 12), "commercial": (1, 4),
    "industrial": (1, 5), "office": (3, 9), "retail": (1, 4), "warehouse": (1, 6), "school": (2, 6),
    "church": (1, 8), "hospital": (3, 9), "university": (2, 6), "garage": (1, 3), "shed": (1, 3),
    "roof": (1, 3), "construction": (1, 3),
}

# --- fixed values: share of residents present by area type and hour, with the default row --------
PRESENCE_HOURS = ["0800", "1200", "1500", "1900", "2300"]
PRESENCE = {
    "Rural": [0.7, 0.6, 0.5, 0.8, 0.9],
    "Suburbana": [0.6, 0.4, 0.5, 0.9, 0.95],
    "Residencial": [0.4, 0.3, 0.4, 0.9, 0.95],
    "Mista": [0.6, 0.7, 0.7, 0.8, 0.7],
    "Comercial": [0.8, 0.9, 0.9, 0.5, 0.1],
}
PRESENCE_DEFAULT = [0.7, 0.6, 0.6, 0.8, 0.8]

# --- fixed values: attenuation in dB by telecom area type (unknown -> 18) ------------------------
ATTENUATION = {"URBANA_DENSA": 28.0, "URBANA": 22.0, "SUBURBANA": 16.0, "RURAL": 10.0}

# --- fixed values: bin edges and labels ----------------------------------------------------------
INF = float("inf")
BINS = {
    "eirp": ([0, 45, 55, 65, 75, INF], ["Muito baixo", "Baixo", "Médio", "Alto", "Muito alto"]),
    "telecom_area": ([0, 3, 8, 15, INF], ["RURAL", "SUBURBANA", "URBANA", "URBANA_DENSA"]),
    "radius": ([0, 1, 3, 5, 10, INF], ["Muito pequeno", "Pequeno", "Médio", "Grande", "Muito grande"]),
    "sector_size": ([0, 0.1, 0.5, 1, 5, INF], ["Muito pequeno", "Pequeno", "Médio", "Grande", "Muito grande"]),
    "isolation": ([0, 50, 100, 200, 500, INF], ["Muito baixo", "Baixo", "Médio", "Alto", "Muito alto"]),
    "road_access": ([0, 10, 25, 50, 100, INF], ["Excelente", "Boa", "Média", "Limitada", "Remota"]),
    "integration": ([0, 5, 10, 15, 20, INF], ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"]),
    "building_slope": ([0, 2, 5, 10, 15, INF], ["Plano", "Suave", "Moderado", "Íngreme", "Muito íngreme"]),
    "land_size": ([0, 0.01, 0.05, 0.25, 1.0, INF], ["Muito pequeno", "Pequeno", "Médio", "Grande", "Muito grande"]),
    "compactness": ([0, 0.4, 0.6, 0.8, 1.0], ["Baixa", "Média", "Alta", "Muito alta"]),
    "elevation_range": ([0, 5, 15, 30, 50, INF], ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"]),
    "land_slope": ([0, 3, 8, 16, 30, INF], ["Plano", "Suave", "Moderado", "Íngreme", "Muito íngreme"]),
    "road_slope": ([0, 3, 8, 15, 30, INF], ["Plana", "Suave", "Moderada", "Íngreme", "Muito Íngreme"]),
    "relief": ([0, 5, 20, 50, 100, INF], ["Muito Plano", "Suave", "Moderado", "Acidentado", "Montanhoso"]),
    "elevation_zone": ([0, 600, 800, 1000, 1200, INF],
                       ["Baixada", "Colinas Baixas", "Colinas Altas", "Montanhas Baixas", "Montanhas Altas"]),
    "eco": ([0, 0.2, 0.4, 0.6, 0.8, 1.0], ["Muito Baixa", "Baixa", "Média", "Alta", "Muito Alta"]),
    "importance": ([0, 0.2, 0.4, 0.6, 0.8, 1.0], ["Muito Baixa", "Baixa", "Média", "Alta", "Crítica"]),
    "fifths": ([0, 0.2, 0.4, 0.6, 0.8, 1.0], ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"]),
    "variation": ([0, 0.2, 0.4, 0.6, 0.8, INF], ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"]),
    "census_area": ([0, 1000, 3000, 5000, 10000, INF], ["Rural", "Suburbana", "Residencial", "Mista", "Comercial"]),
    "flood_index": ([0, 20, 40, 60, 80, 100], ["Muito Baixo", "Baixo", "Médio", "Alto", "Muito Alto"]),
    "hex_vulnerability": ([-1, 0, 1, 2, 10],
                          ["Sem cobertura", "Alta vulnerabilidade", "Média vulnerabilidade", "Baixa vulnerabilidade"]),
    "hydro_distance": ([0, 30, 50, 100, 200, 500, INF],
                       ["0-30m", "30-50m", "50-100m", "100-200m", "200-500m", ">500m"]),
    "population_density": ([0, 0.005, 0.01, 0.02, 0.05, INF], ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"]),
    "grid_density": ([0, 1000, 5000, 10000, 20000, INF], ["Muito baixa", "Baixa", "Média", "Alta", "Muito alta"]),
    "bedroom": ([0, 0.5, 1.0, 1.5, 2.0, INF], ["Muito baixa", "Baixa", "Normal", "Alta", "Muito alta"]),
    "road_length": ([-INF, 50, 100, 250, 500, 1000, INF],
                    ["muito_curto", "curto", "medio_curto", "medio", "longo", "muito_longo"]),
    "road_sinuosity": ([0.999, 1.05, 1.15, 1.3, 1.5, INF],
                       ["reta", "quase_reta", "pouco_sinuosa", "sinuosa", "muito_sinuosa"]),
}

# --- fixed values: functional category by building tag, amenity tag and land use -----------------
BUILDING_FUNCTION = {
    "house": "residencial.unifamiliar", "residential": "residencial.multifamiliar",
    "apartments": "residencial.multifamiliar", "commercial": "comercial.escritorios",
    "retail": "comercial.varejo", "industrial": "industrial.fabrica", "warehouse": "industrial.armazenamento",
    "school": "institucional.educacao", "university": "institucional.educacao",
    "hospital": "institucional.saude", "church": "institucional.religioso", "hotel": "comercial.hospedagem",
    "public": "institucional.governo", "office": "comercial.escritorios", "shed": "industrial.armazenamento",
}
AMENITY_FUNCTION = {
    "school": "institucional.educacao", "university": "institucional.educacao",
    "library": "institucional.cultural", "hospital": "institucional.saude", "clinic": "institucional.saude",
    "doctors": "institucional.saude", "restaurant": "comercial.restauracao", "cafe": "comercial.restauracao",
    "fast_food": "comercial.restauracao", "bank": "comercial.escritorios", "marketplace": "comercial.varejo",
    "place_of_worship": "institucional.religioso", "police": "infraestrutura.seguranca",
    "fire_station": "infraestrutura.seguranca", "post_office": "institucional.governo",
    "town_hall": "institucional.governo",
}
LANDUSE_FUNCTION = {
    "residential": "residencial", "commercial": "comercial", "retail": "comercial", "industrial": "industrial",
    "institutional": "institucional", "mixed": "residencial.misto", "education": "institucional.educacao",
    "healthcare": "institucional.saude", "transportation": "infraestrutura.transporte",
}

# --- fixed values: land-use words naming a zone, first hit wins ----------------------------------
ZONE_WORDS = {
    "residential": ["residencial", "habitacional", "housing", "dwelling"],
    "commercial": ["comercial", "retail", "business", "service"],
    "industrial": ["industrial", "factory", "manufacturing", "plant"],
    "institutional": ["institucional", "public", "government", "education", "health"],
    "mixed": ["mixed", "misto", "mixed_use", "multiple"],
    "green": ["green", "park", "recreation", "forest", "rural", "agriculture"],
    "conservation": ["conservation", "preserve", "protected", "environmental"],
}

# --- fixed values: zoning rules as (zone, level, functional prefixes) ----------------------------
ZONING_RULES = [
    ("residential", "permitido", ["residencial", "institucional_educacao", "institucional_religioso"]),
    ("residential", "condicional", ["comercial_varejo", "comercial_escritorios", "institucional_saude"]),
    ("residential", "proibido", ["industrial", "infraestrutura"]),
    ("commercial", "permitido", ["comercial", "residencial_misto", "institucional"]),
    ("commercial", "condicional", ["residencial", "industrial_armazenamento"]),
    ("commercial", "proibido", ["industrial_fabrica", "infraestrutura_utilidades"]),
    ("industrial", "permitido", ["industrial", "infraestrutura", "comercial_escritorios"]),
    ("industrial", "condicional", ["comercial_varejo", "comercial_restauracao"]),
    ("industrial", "proibido", ["residencial", "institucional_saude", "institucional_educacao"]),
    ("institutional", "permitido", ["institucional", "infraestrutura_seguranca", "comercial_escritorios"]),
    ("institutional", "condicional", ["comercial", "residencial"]),
    ("institutional", "proibido", ["industrial"]),
    ("mixed", "permitido", ["residencial", "comercial", "institucional"]),
    ("mixed", "condicional", ["industrial_armazenamento", "infraestrutura"]),
    ("mixed", "proibido", ["industrial_fabrica"]),
    ("green", "permitido", ["institucional_cultural", "infraestrutura_utilidades"]),
    ("green", "condicional", ["comercial_restauracao", "institucional"]),
    ("green", "proibido", ["residencial", "comercial_varejo", "industrial"]),
    ("conservation", "permitido", ["institucional_cultural"]),
    ("conservation", "condicional", ["infraestrutura_utilidades"]),
    ("conservation", "proibido", ["residencial", "comercial", "industrial", "institucional_saude"]),
]

# --- fixed values: words for use categories, in the order they are tried -------------------------
USE_WORDS = {
    "residential": ["residencial", "residential", "house", "apartamento", "apartments", "habitacional",
                    "dwelling", "casa", "moradia", "housing"],
    "commercial": ["comercial", "commercial", "retail", "shop", "store", "shopping", "mercado", "escritorio",
                   "office", "business", "serviço", "service"],
    "industrial": ["industrial", "industry", "factory", "fábrica", "manufacturing", "warehouse", "storage"],
    "institutional": ["institucional", "institutional", "education", "school", "escola", "hospital", "health",
                      "saúde", "government", "governo", "public", "público"],
}
PROFILE_WORDS = {
    "school": ["school", "education", "educational", "university", "college", "academia"],
    "hospital": ["hospital", "healthcare", "clinic", "medical", "saude", "health"],
    "retail": ["retail", "shop", "store", "shopping", "mercado", "loja", "varejo"],
    "office": ["office", "escritorio", "business", "corporate", "empresa"],
    "restaurant": ["restaurant", "bar", "cafe", "food", "restaurante"],
}
PROFILE_FALLBACK = {
    "residential": ["resid", "habit", "house", "apart", "dwelling"],
    "commercial": ["comer", "shop", "loja", "retail", "mercado"],
    "industrial": ["indus", "factor", "fabri", "manufact", "warehouse"],
    "institutional": ["instit", "public", "gov", "escola", "hospital"],
    "mixed": ["mix", "misto"],
}

# --- fixed values: natural-area domain -----------------------------------------------------------
NATURAL_TYPES = ["forest", "wetland", "grassland", "park", "reserve", "other"]

# --- fixed values: valid ranges per layer (column, minimum, maximum) -----------------------------
RANGES = {
    "roads": [("length_km", 0, None), ("sinuosity", 1, None)],
    "buildings": [("height", 0, None), ("levels", 1, None), ("area_m2", 0, None), ("perimeter_m", 0, None),
                  ("compactness_index", 0, 1)],
    "landuse": [("area_km2", 0, None), ("perimeter_km", 0, None), ("compactness", 0, 1)],
    "railways": [("length_km", 0, None), ("gauge_mm", 0, None), ("sinuosity", 1, None)],
    "hydro": [("nucomptrec", 0, None), ("nustrahler", 1, 10), ("nuarea", 0, None), ("nucomprio", 0, None)],
    "weather": [("latitude", -90, 90), ("longitude", -180, 180), ("temperature_c", -40, 50),
                ("humidity_pct", 0, 100), ("pressure_mb", 800, 1100), ("wind_speed_ms", 0, 100),
                ("wind_direction_deg", 0, 360), ("precipitation_mm", 0, 500), ("radiation_kjm2", 0, None)],
}

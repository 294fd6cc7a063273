"""Detailed economic sectors of the factor accounts and the benchmark sector each belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Public sector names of the multi-regional input-output accounts, by benchmark sector.
DETAIL_SECTORS = {
    "Basic Materials": [
        "Aluminium production",
        "Casting of metals",
        "Chemicals nec",
        "Copper production",
        "Lead, zinc and tin production",
        "Manufacture of basic iron and steel and of ferro-alloys and first products thereof",
        "Manufacture of bricks, tiles and construction products, in baked clay",
        "Manufacture of cement, lime and plaster",
        "Manufacture of ceramic goods",
        "Manufacture of coke oven products",
        "Manufacture of glass and glass products",
        "Manufacture of other non-metallic mineral products n.e.c.",
        "Manufacture of rubber and plastic products (25)",
        "Manufacture of wood and of products of wood and cork, except furniture; manufacture of articles of straw and plaiting materials (20)",
        "Mining of aluminium ores and concentrates",
        "Mining of chemical and fertilizer minerals, production of salt, other mining and quarrying n.e.c.",
        "Mining of copper ores and concentrates",
        "Mining of iron ores",
        "Mining of lead, zinc and tin ores and concentrates",
        "Mining of nickel ores and concentrates",
        "Mining of other non-ferrous metal ores and concentrates",
        "Mining of precious metal ores and concentrates",
        "N-fertiliser",
        "Other non-ferrous metal production",
        "P- and other fertiliser",
        "Paper",
        "Plastics, basic",
        "Precious metals production",
        "Pulp",
        "Quarrying of sand and clay",
        "Quarrying of stone",
        "Re-processing of ash into clinker",
        "Re-processing of secondary aluminium into new aluminium",
        "Re-processing of secondary construction material into aggregates",
        "Re-processing of secondary copper into new copper",
        "Re-processing of secondary glass into new glass",
        "Re-processing of secondary lead into new lead, zinc and tin",
        "Re-processing of secondary other non-ferrous metals into new other non-ferrous metals",
        "Re-processing of secondary paper into new pulp",
        "Re-processing of secondary plastic into new plastic",
        "Re-processing of secondary preciuos metals into new preciuos metals",
        "Re-processing of secondary steel into new steel",
        "Re-processing of secondary wood material into new wood material",
        "Forestry, logging and related service activities (02)",
    ],
    "Energy": [
        "Extraction of crude petroleum and services related to crude oil extraction, excluding surveying",
        "Extraction of natural gas and services related to natural gas extraction, excluding surveying",
        "Extraction, liquefaction, and regasification of other petroleum and gaseous materials",
        "Mining of coal and lignite; extraction of peat (10)",
        "Mining of uranium and thorium ores (12)",
        "Petroleum Refinery",
        "Processing of nuclear fuel",
        "Retail sale of automotive fuel",
    ],
    "Utilities": [
        "Collection, purification and distribution of water (41)",
        "Distribution and trade of electricity",
        "Manufacture of gas; distribution of gaseous fuels through mains",
        "Production of electricity by Geothermal",
        "Production of electricity by biomass and waste",
        "Production of electricity by coal",
        "Production of electricity by gas",
        "Production of electricity by hydro",
        "Production of electricity by nuclear",
        "Production of electricity by petroleum and other oil derivatives",
        "Production of electricity by solar photovoltaic",
        "Production of electricity by solar thermal",
        "Production of electricity by tide, wave, ocean",
        "Production of electricity by wind",
        "Production of electricity nec",
        "Steam and hot water supply",
        "Transmission of electricity",
    ],
    "Consumer Defensive": [
        "Animal products nec",
        "Cattle farming",
        "Cultivation of cereal grains nec",
        "Cultivation of crops nec",
        "Cultivation of oil seeds",
        "Cultivation of paddy rice",
        "Cultivation of plant-based fibers",
        "Cultivation of sugar cane, sugar beet",
        "Cultivation of vegetables, fruit, nuts",
        "Cultivation of wheat",
        "Fishing, operating of fish hatcheries and fish farms; service activities incidental to fishing (05)",
        "Manufacture of beverages",
        "Manufacture of fish products",
        "Manufacture of tobacco products (16)",
        "Manure treatment (biogas), storage and land application",
        "Manure treatment (conventional), storage and land application",
        "Meat animals nec",
        "Pigs farming",
        "Poultry farming",
        "Processed rice",
        "Processing of Food products nec",
        "Processing of dairy products",
        "Processing of meat cattle",
        "Processing of meat pigs",
        "Processing of meat poultry",
        "Processing vegetable oils and fats",
        "Production of meat products nec",
        "Raw milk",
        "Sugar refining",
        "Wool, silk-worm cocoons",
    ],
    "Consumer Cyclical": [
        "Hotels and restaurants (55)",
        "Manufacture of furniture; manufacturing n.e.c. (36)",
        "Manufacture of motor vehicles, trailers and semi-trailers (34)",
        "Manufacture of textiles (17)",
        "Manufacture of wearing apparel; dressing and dyeing of fur (18)",
        "Recreational, cultural and sporting activities (92)",
        "Renting of machinery and equipment without operator and of personal and household goods (71)",
        "Retail trade, except of motor vehicles and motorcycles; repair of personal and household goods (52)",
        "Sale, maintenance, repair of motor vehicles, motor vehicles parts, motorcycles, motor cycles parts and accessoiries",
        "Tanning and dressing of leather; manufacture of luggage, handbags, saddlery, harness and footwear (19)",
        "Wholesale trade and commission trade, except of motor vehicles and motorcycles (51)",
    ],
    "Industrials": [
        "Air transport (62)",
        "Construction (45)",
        "Inland water transport",
        "Manufacture of electrical machinery and apparatus n.e.c. (31)",
        "Manufacture of fabricated metal products, except machinery and equipment (28)",
        "Manufacture of machinery and equipment n.e.c. (29)",
        "Manufacture of other transport equipment (35)",
        "Other business activities (74)",
        "Other land transport",
        "Publishing, printing and reproduction of recorded media (22)",
        "Sea and coastal water transport",
        "Supporting and auxiliary transport activities; activities of travel agencies (63)",
        "Transport via pipelines",
        "Transport via railways",
        "Biogasification of food waste, incl. land application",
        "Biogasification of paper, incl. land application",
        "Biogasification of sewage slugde, incl. land application",
        "Composting of food waste, incl. land application",
        "Composting of paper and wood, incl. land application",
        "Incineration of waste: Food",
        "Incineration of waste: Metals and Inert materials",
        "Incineration of waste: Oil/Hazardous waste",
        "Incineration of waste: Paper",
        "Incineration of waste: Plastic",
        "Incineration of waste: Textiles",
        "Incineration of waste: Wood",
        "Landfill of waste: Food",
        "Landfill of waste: Inert/metal/hazardous",
        "Landfill of waste: Paper",
        "Landfill of waste: Plastic",
        "Landfill of waste: Textiles",
        "Landfill of waste: Wood",
        "Recycling of bottles by direct reuse",
        "Recycling of waste and scrap",
        "Waste water treatment, food",
        "Waste water treatment, other",
    ],
    "Technology": [
        "Computer and related activities (72)",
        "Manufacture of medical, precision and optical instruments, watches and clocks (33)",
        "Manufacture of office machinery and computers (30)",
        "Manufacture of radio, television and communication equipment and apparatus (32)",
        "Research and development (73)",
    ],
    "Communication Services": [
        "Post and telecommunications (64)",
        "Activities of membership organisation n.e.c. (91)",
    ],
    "Financial Services": [
        "Activities auxiliary to financial intermediation (67)",
        "Financial intermediation, except insurance and pension funding (65)",
        "Insurance and pension funding, except compulsory social security (66)",
    ],
    "Real Estate": ["Real estate activities (70)"],
    "Healthcare": ["Health and social work (85)"],
    "Other": [
        "Education (80)",
        "Other service activities (93)",
        "Private households with employed persons (95)",
        "Public administration and defence; compulsory social security (75)",
    ],
}


def detail_sectors(spark: SparkSession) -> DataFrame:
    rows = [(name, bucket) for bucket, names in DETAIL_SECTORS.items() for name in names]
    return spark.createDataFrame(rows, "detail string, bucket string")

"""Word lists for generated and masked values; they may only grow at their ends, since values pick by position."""

GIVEN = "Ada Bela Carla Dario Elin Farid Greta Hana Ilya Jonas Kira Luca Mina Nils Oona Pavel Quirin Rosa Selma Tarek Una Vito Wanda Yara Zeno".split()
FAMILY = "Arden Bakker Castell Dorn Eriksen Falk Grau Holm Imber Jansen Koval Lindt Moran Novak Orlov Pinto Quist Reyes Sato Tamm Ulrich Varga Wolff Yilmaz Zander".split()
WORDS = "amber basalt cedar delta ember fjord gravel harbor indigo juniper kelp lagoon meadow nickel opal prairie quartz ridge sierra timber umber valley willow yarrow zephyr".split()
STREETS = "Alder Birch Chestnut Dogwood Elm Fir Hazel Larch Maple Oak Pine Rowan Spruce Walnut".split()
STREET_TYPES = ["Street", "Lane", "Road", "Avenue", "Way"]
CITIES = "Amberfield Brookhaven Clearwater Dunmore Eastvale Fairport Glenrock Highmoor Ironbridge Lakeview Northgate Southmere Westbrook".split()
REGIONS = "North South East West Central Coastal Highland Lowland".split()
COUNTRIES = "Austria Belgium Canada Denmark Estonia Finland Germany Ireland Japan Latvia Norway Portugal Spain Sweden".split()
COUNTRY_CODES = "AT BE CA DK EE FI DE IE JP LV NO PT ES SE".split()
COMPANIES = ["Aster Works", "Bluefin Labs", "Cobalt Foods", "Driftwood Media", "Evergreen Tools", "Foxglove Health", "Granite Freight"]
JOBS = ["Analyst", "Buyer", "Controller", "Designer", "Engineer", "Planner", "Technician"]
DEPARTMENTS = ["Finance", "Logistics", "Marketing", "Operations", "Research", "Support"]
PRODUCTS = ["Desk Lamp", "Field Notebook", "Garden Hose", "Kettle", "Rain Jacket", "Trail Shoe", "Wall Clock"]
CURRENCIES = "CAD CHF DKK EUR GBP JPY NOK SEK USD".split()
STATUSES = "new open waiting active closed archived".split()
#: Domains that no mail reaches, and the documentation networks.
DOMAINS = ["example.com", "example.net", "example.org"]
TEST_NETS = ["192.0.2.", "198.51.100.", "203.0.113."]
#: BBAN lengths by country.
BBAN = {"DE": 18, "FR": 23, "GB": 18, "ES": 20, "NL": 14, "IT": 23}

"""Fixed values of the data contract.

Everything in this file is part of the results: property names, codes, texts
and word lists that callers of the engine compare for equality. They are
stated here once, plainly, and used by every operator.
"""

# --- fixed values: object types, entities, tables --------------------------

COMPANIES, CONTACTS, DEALS, LINE_ITEMS = "companies", "contacts", "deals", "line_items"
OBJECT_TYPES = [COMPANIES, CONTACTS, DEALS, LINE_ITEMS]  # parents first

COMPANY, CONTACT, DEAL, LINE_ITEM = "company", "contact", "deal", "line_item"
ENTITIES = [COMPANY, CONTACT, DEAL, LINE_ITEM]  # parents first
OBJECT_TYPE_OF = dict(zip(ENTITIES, OBJECT_TYPES))

TABLE_OF = {COMPANY: "Companies", CONTACT: "Contacts", DEAL: "Deals", LINE_ITEM: "Line Items"}

# --- fixed values: property and column names -------------------------------

EXTERNAL_ID = "external_source_id"
SOURCE_SYSTEM = "external_source_system"
KNOWN_ID = "hubspot_record_id"
MODIFIED = "last_modified"
STAMPS = [EXTERNAL_ID, SOURCE_SYSTEM]

PROPERTIES = {
    COMPANIES: ["name", "domain", "industry", "numberofemployees"],
    CONTACTS: ["firstname", "lastname", "email", "phone", "lifecyclestage"],
    DEALS: ["dealname", "amount", "dealstage", "closedate", "pipeline"],
    LINE_ITEMS: ["name", "quantity", "price"],
}
NATURAL_KEY = {COMPANIES: "domain", CONTACTS: "email", DEALS: None, LINE_ITEMS: None}

LINK_FIELDS = {
    COMPANY: ["Company", "Companies", "Linked Company"],
    DEAL: ["Deal", "Deals", "Linked Deal"],
}

# --- fixed values: sources --------------------------------------------------

CSV_SOURCE, CSV_SYSTEM = "csv", "csv_migration"
RECORD_SOURCE, RECORD_SYSTEM = "airtable", "airtable"
DRY_RUN_PREFIX = "dry-run:"

# --- fixed values: deal stages, statuses, lifecycle stages -------------------

DEAL_STAGES = [
    "appointmentscheduled", "qualifiedtobuy", "presentationscheduled",
    "decisionmakerboughtin", "contractsent", "closedwon", "closedlost",
]
DEFAULT_STAGE, WON_STAGE, LOST_STAGE = "qualifiedtobuy", "closedwon", "closedlost"
DEFAULT_PIPELINE = "default"
WON_STATUSES = ["won", "closed won", "closedwon"]
LOST_STATUSES = ["lost", "closed lost", "closedlost"]
LIFECYCLE_STAGES = [
    "subscriber", "lead", "marketingqualifiedlead", "salesqualifiedlead",
    "opportunity", "customer", "evangelist", "other",
]

# --- fixed values: error codes ------------------------------------------------

VALIDATION_ERROR, MISSING_REFERENCE = "VALIDATION_ERROR", "MISSING_REFERENCE"
TRANSIENT_CODES = [
    "ECONNRESET", "ETIMEDOUT", "ECONNABORTED", "ENOTFOUND", "EAI_AGAIN", "EPIPE", "ECONNREFUSED",
]

TARGET_REFUSED = "TARGET_REFUSED"
SYNCED, SKIPPED, FAILED, REJECTED = "synced", "skipped", "failed", "rejected"
CREATED, UPDATED = "created", "updated"
BLANK_RECORD, RECORD_NOT_FOUND = "blank_record", "record_not_found"
BY_KNOWN_ID, BY_EXTERNAL_ID, BY_NATURAL_KEY = "hubspot_record_id", "external_source_id", "natural_key"

# --- fixed values: texts ------------------------------------------------------

MISSING_KEY = "Missing {field}"
ORPHAN = 'Referenced {field}="{value}" does not exist in companies.csv'
ORPHAN_KEPT = "; imported without company association"
NO_COMPANY_NAME = "company_name is empty; HubSpot companies require a name"
NO_DEAL_NAME = "deal_name is empty; HubSpot deals require a name"
BAD_EMAIL = 'Missing or invalid email "{value}"'
BAD_DOMAIN = 'Could not normalise domain "{value}"'
BAD_EMPLOYEES = 'Could not parse number_of_employees "{value}"'
BAD_INDUSTRY = 'Industry "{value}" is not a HubSpot value, omitted'
BAD_LIFECYCLE = 'Unrecognised lifecycle_stage "{value}", omitted'
BAD_STAGE = 'Unrecognised deal_stage "{value}", defaulted to qualifiedtobuy'
BAD_AMOUNT = 'Could not parse amount "{value}"'
BAD_CLOSE_DATE = 'Could not parse close_date "{value}", omitted'
RECORD_NO_COMPANY_NAME = "company_name is required to sync a Company"
RECORD_BAD_EMAIL = 'A valid email is required to sync a Contact (got "{value}")'
RECORD_NO_DEAL_NAME = "deal_name is required to sync a Deal"
RECORD_NO_PRODUCT_NAME = "product_name is required to sync a Line Item"
RECORD_BAD_CLOSE_DATE = "close_date could not be parsed and was omitted"
NO_PARENT = "No linked {table} record found (link fields: {links}; {key}=\"{value}\")"
PARENT_FAILED = "Parent {parent} failed to sync: {value}"
NOT_MIGRATED_FROM = "{type} record was not migrated"
NOT_MIGRATED_TO = "{type} record {value} was not migrated"
EDGE_LABELS = {
    (CONTACTS, COMPANIES): "Contact → Company",
    (DEALS, COMPANIES): "Deal → Company",
    (DEALS, CONTACTS): "Deal → Contact",
}

# --- fixed values: operating defaults ------------------------------------------

BATCH_SIZE = 100
LOOKBACK_MINUTES = 10
MOST_ATTEMPTS = 5
UNKNOWN_TABLE = 'Unknown or missing table name "{value}". Expected one of: Companies, Contacts, Deals, Line Items.'

# --- fixed values: accepted industries -------------------------------------------

INDUSTRIES = """
ACCOUNTING AIRLINES_AVIATION ALTERNATIVE_DISPUTE_RESOLUTION ALTERNATIVE_MEDICINE ANIMATION
APPAREL_FASHION ARCHITECTURE_PLANNING ARTS_AND_CRAFTS AUTOMOTIVE AVIATION_AEROSPACE BANKING
BIOTECHNOLOGY BROADCAST_MEDIA BUILDING_MATERIALS BUSINESS_SUPPLIES_AND_EQUIPMENT CAPITAL_MARKETS
CHEMICALS CIVIC_SOCIAL_ORGANIZATION CIVIL_ENGINEERING COMMERCIAL_REAL_ESTATE
COMPUTER_NETWORK_SECURITY COMPUTER_GAMES COMPUTER_HARDWARE COMPUTER_NETWORKING COMPUTER_SOFTWARE
INTERNET CONSTRUCTION CONSUMER_ELECTRONICS CONSUMER_GOODS CONSUMER_SERVICES COSMETICS DAIRY
DEFENSE_SPACE DESIGN EDUCATION_MANAGEMENT E_LEARNING ELECTRICAL_ELECTRONIC_MANUFACTURING
ENTERTAINMENT ENVIRONMENTAL_SERVICES EVENTS_SERVICES EXECUTIVE_OFFICE FACILITIES_SERVICES FARMING
FINANCIAL_SERVICES FINE_ART FISHERY FOOD_BEVERAGES FOOD_PRODUCTION FUND_RAISING FURNITURE
GAMBLING_CASINOS GLASS_CERAMICS_CONCRETE GOVERNMENT_ADMINISTRATION GOVERNMENT_RELATIONS
GRAPHIC_DESIGN HEALTH_WELLNESS_AND_FITNESS HIGHER_EDUCATION HOSPITAL_HEALTH_CARE HOSPITALITY
HUMAN_RESOURCES IMPORT_AND_EXPORT INDIVIDUAL_FAMILY_SERVICES INDUSTRIAL_AUTOMATION
INFORMATION_SERVICES INFORMATION_TECHNOLOGY_AND_SERVICES INSURANCE INTERNATIONAL_AFFAIRS
INTERNATIONAL_TRADE_AND_DEVELOPMENT INVESTMENT_BANKING INVESTMENT_MANAGEMENT JUDICIARY
LAW_ENFORCEMENT LAW_PRACTICE LEGAL_SERVICES LEGISLATIVE_OFFICE LEISURE_TRAVEL_TOURISM LIBRARIES
LOGISTICS_AND_SUPPLY_CHAIN LUXURY_GOODS_JEWELRY MACHINERY MANAGEMENT_CONSULTING MARITIME
MARKET_RESEARCH MARKETING_AND_ADVERTISING MECHANICAL_OR_INDUSTRIAL_ENGINEERING MEDIA_PRODUCTION
MEDICAL_DEVICES MEDICAL_PRACTICE MENTAL_HEALTH_CARE MILITARY MINING_METALS
MOTION_PICTURES_AND_FILM MUSEUMS_AND_INSTITUTIONS MUSIC NANOTECHNOLOGY NEWSPAPERS
NON_PROFIT_ORGANIZATION_MANAGEMENT OIL_ENERGY ONLINE_MEDIA OUTSOURCING_OFFSHORING
PACKAGE_FREIGHT_DELIVERY PACKAGING_AND_CONTAINERS PAPER_FOREST_PRODUCTS PERFORMING_ARTS
PHARMACEUTICALS PHILANTHROPY PHOTOGRAPHY PLASTICS POLITICAL_ORGANIZATION
PRIMARY_SECONDARY_EDUCATION PRINTING PROFESSIONAL_TRAINING_COACHING PROGRAM_DEVELOPMENT
PUBLIC_POLICY PUBLIC_RELATIONS_AND_COMMUNICATIONS PUBLIC_SAFETY PUBLISHING RAILROAD_MANUFACTURE
RANCHING REAL_ESTATE RECREATIONAL_FACILITIES_AND_SERVICES RELIGIOUS_INSTITUTIONS
RENEWABLES_ENVIRONMENT RESEARCH RESTAURANTS RETAIL SECURITY_AND_INVESTIGATIONS SEMICONDUCTORS
SHIPBUILDING SPORTING_GOODS SPORTS STAFFING_AND_RECRUITING SUPERMARKETS TELECOMMUNICATIONS
TEXTILES THINK_TANKS TOBACCO TRANSLATION_AND_LOCALIZATION TRANSPORTATION_TRUCKING_RAILROAD
UTILITIES VENTURE_CAPITAL_PRIVATE_EQUITY VETERINARY WAREHOUSING WHOLESALE WINE_AND_SPIRITS
WIRELESS WRITING_AND_EDITING MOBILE_GAMES
""".split()

# --- fixed values: everyday labels of accepted industries (compared trimmed, in lower case) ---

INDUSTRY_ALIASES = {
    "agriculture": "FARMING",
    "biotech": "BIOTECHNOLOGY",
    "biotechnology": "BIOTECHNOLOGY",
    "construction": "CONSTRUCTION",
    "consulting": "MANAGEMENT_CONSULTING",
    "defense": "DEFENSE_SPACE",
    "defence": "DEFENSE_SPACE",
    "education": "HIGHER_EDUCATION",
    "energy": "OIL_ENERGY",
    "engineering": "MECHANICAL_OR_INDUSTRIAL_ENGINEERING",
    "finance": "FINANCIAL_SERVICES",
    "fintech": "FINANCIAL_SERVICES",
    "food & beverage": "FOOD_BEVERAGES",
    "food and beverage": "FOOD_BEVERAGES",
    "healthcare": "HOSPITAL_HEALTH_CARE",
    "health care": "HOSPITAL_HEALTH_CARE",
    "hospitality": "HOSPITALITY",
    "insurance": "INSURANCE",
    "legal": "LEGAL_SERVICES",
    "logistics": "LOGISTICS_AND_SUPPLY_CHAIN",
    "manufacturing": "MACHINERY",
    "marketing": "MARKETING_AND_ADVERTISING",
    "advertising": "MARKETING_AND_ADVERTISING",
    "media": "BROADCAST_MEDIA",
    "pharmaceuticals": "PHARMACEUTICALS",
    "pharma": "PHARMACEUTICALS",
    "r&d": "RESEARCH",
    "real estate": "REAL_ESTATE",
    "retail": "RETAIL",
    "robotics": "MECHANICAL_OR_INDUSTRIAL_ENGINEERING",
    "software": "COMPUTER_SOFTWARE",
    "technology": "INFORMATION_TECHNOLOGY_AND_SERVICES",
    "tech": "INFORMATION_TECHNOLOGY_AND_SERVICES",
    "it": "INFORMATION_TECHNOLOGY_AND_SERVICES",
    "telecom": "TELECOMMUNICATIONS",
    "telecommunications": "TELECOMMUNICATIONS",
    "transportation": "TRANSPORTATION_TRUCKING_RAILROAD",
    "automotive": "AUTOMOTIVE",
    "aerospace": "AVIATION_AEROSPACE",
    "accounting": "ACCOUNTING",
    "banking": "BANKING",
    "wholesale": "WHOLESALE",
    "distribution": "WHOLESALE",
    "security": "SECURITY_AND_INVESTIGATIONS",
    "hr": "HUMAN_RESOURCES",
    "human resources": "HUMAN_RESOURCES",
    "entertainment": "ENTERTAINMENT",
    "internet": "INTERNET",
    "nonprofit": "NON_PROFIT_ORGANIZATION_MANAGEMENT",
    "non-profit": "NON_PROFIT_ORGANIZATION_MANAGEMENT",
}

# --- fixed values: words of a boolean column ---------------------------------------

TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]

# --- fixed values: month names; accepted are the full name, its first three letters, and "sept" ---

MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

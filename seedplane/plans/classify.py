"""Semantic classes from column names and types."""

from __future__ import annotations

import re

#: The ordered name rules; a column matches a token that it equals or ends with after an underscore.
RULES: list[tuple[str, str]] = [
    ("EMAIL", "email e_mail email_address mail"),
    ("PHONE", "phone phone_number mobile telephone fax msisdn"),
    ("SSN", "ssn social_security social_security_number"),
    ("NATIONAL_ID", "national_id tax_id tin nino passport passport_number"),
    ("CREDIT_CARD", "credit_card card_number cc_number pan"),
    ("IBAN", "iban bank_account account_number_iban"),
    ("DATE_OF_BIRTH", "date_of_birth birth_date birthdate dob born_on"),
    ("GIVEN_NAME", "first_name firstname given_name forename"),
    ("FAMILY_NAME", "last_name lastname surname family_name"),
    ("FULL_NAME", "full_name fullname display_name contact_name customer_name person_name recipient_name"),
    ("USERNAME", "username user_name login handle screen_name"),
    ("PASSWORD_HASH", "password password_hash passwd pwd secret salt"),
    ("API_TOKEN", "api_key api_token access_token refresh_token token session_token auth_token"),
    ("STREET_ADDRESS", "address street address_line1 address_line_1 address1 street_address line1"),
    ("CITY", "city town locality"),
    ("REGION", "state province region county"),
    ("POSTAL_CODE", "zip zipcode zip_code postal_code postcode"),
    ("COUNTRY", "country country_code nation"),
    ("LATITUDE", "latitude lat"),
    ("LONGITUDE", "longitude lng lon"),
    ("IP_ADDRESS", "ip ip_address client_ip remote_addr ipv4 ipv6"),
    ("MAC_ADDRESS", "mac mac_address"),
    ("USER_AGENT", "user_agent useragent"),
    ("URL", "url uri website link href callback_url webhook_url"),
    ("COMPANY", "company company_name organization organisation employer vendor"),
    ("JOB_TITLE", "job_title title_role position role_title"),
    ("DEPARTMENT", "department dept division team"),
    ("PRODUCT_NAME", "product_name sku_name item_name"),
    ("CURRENCY_CODE", "currency currency_code ccy"),
    ("MONETARY_AMOUNT", "price amount total subtotal cost balance fee revenue salary unit_price grand_total tax_amount discount"),
    ("QUANTITY", "quantity qty count stock units inventory"),
    ("PERCENTAGE", "percent percentage rate ratio discount_pct"),
    ("CREATED_TIMESTAMP", "created_at created_on created inserted_at date_created"),
    ("UPDATED_TIMESTAMP", "updated_at updated_on modified_at last_modified changed_at"),
    ("DURATION", "duration duration_ms elapsed elapsed_ms timeout ttl"),
    ("SLUG", "slug permalink url_key"),
    ("TITLE", "title subject headline label caption"),
    ("FREE_TEXT", "description notes note comment comments body content message summary bio remarks"),
    ("STATUS_FLAG", "status state stage phase kind type category"),
]
TEXT = "varchar text bpchar char citext name inet cidr macaddr macaddr8 uuid".split()
NUMERIC = "int2 int4 int8 numeric float4 float8 money".split()
INTEGERS = "int2 int4 int8".split()
TEMPORAL = "timestamp timestamptz date time timetz interval".split()
#: The class of a type that no name rule claims.
BY_TYPE = {
    "bool": "BOOLEAN_FLAG", "timestamp": "TIMESTAMP", "timestamptz": "TIMESTAMP", "date": "DATE", "time": "DURATION", "timetz": "DURATION", "interval": "DURATION", "json": "JSON_DOCUMENT", "jsonb": "JSON_DOCUMENT", "bytea": "BINARY_BLOB", "uuid": "SURROGATE_KEY",
    "inet": "IP_ADDRESS", "cidr": "IP_ADDRESS", "macaddr": "MAC_ADDRESS", "macaddr8": "MAC_ADDRESS", "numeric": "MONETARY_AMOUNT", "float4": "MONETARY_AMOUNT", "float8": "MONETARY_AMOUNT", "money": "MONETARY_AMOUNT", "text": "FREE_TEXT", "varchar": "TITLE", "bpchar": "TITLE", "char": "TITLE",
}
_NEEDS = {c: NUMERIC for c in ("MONETARY_AMOUNT", "QUANTITY", "PERCENTAGE", "LATITUDE", "LONGITUDE")} | {c: TEMPORAL for c in ("DATE_OF_BIRTH", "CREATED_TIMESTAMP", "UPDATED_TIMESTAMP")} | {"DURATION": NUMERIC + TEMPORAL}


def normalise(name: str) -> str:
    return re.sub("_+", "_", name.lower().replace("-", "_").replace(" ", "_")).strip("_")


def classify(name: str, type_: str, enum: bool = False, key: bool = False, foreign: bool = False) -> str:
    name, type_ = normalise(name), (type_ or "").lower()
    if foreign:
        return "FOREIGN_KEY"
    if key and type_ in (*INTEGERS, "uuid"):
        return "SURROGATE_KEY"
    if enum:
        return "ENUM_LABEL"
    for kind, tokens in RULES:
        if type_ in _NEEDS.get(kind, TEXT) and any(name == t or name.endswith("_" + t) for t in tokens.split()):
            return kind
    if type_ in INTEGERS:
        return "SURROGATE_KEY" if name == "id" or name.endswith("_id") else "QUANTITY"
    return BY_TYPE.get(type_, "UNKNOWN")


def case_sql(name: str = "name", type_: str = "type", foreign: str = "is_fk", key: str = "is_key") -> str:
    """The same decision as one SQL CASE over normalised names."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    out = f"case when {foreign} then 'FOREIGN_KEY' when {key} and {type_} in ({quoted(INTEGERS + ['uuid'])}) then 'SURROGATE_KEY'"
    for kind, tokens in RULES:
        match = " or ".join(f"{name} = '{t}' or right({name}, {len(t) + 1}) = '_{t}'" for t in tokens.split())
        out += f" when {type_} in ({quoted(_NEEDS.get(kind, TEXT))}) and ({match}) then '{kind}'"
    out += f" when {type_} in ({quoted(INTEGERS)}) then case when {name} = 'id' or right({name}, 3) = '_id' then 'SURROGATE_KEY' else 'QUANTITY' end"
    return out + "".join(f" when {type_} = '{t}' then '{k}'" for t, k in BY_TYPE.items()) + " else 'UNKNOWN' end"

"""The 22-table commerce schema that plans and runs are tried on, in a one-line-a-table notation.

``!`` not null, ``U`` unique, ``G`` generated, ``=enum`` an enum, ``>table`` a foreign key to its id.
"""

from __future__ import annotations

import re

from seedplane.model import Column, ForeignKey, Schema, Table
from seedplane.plans.classify import classify

#: Enum labels in their order.
ENUMS = {
    "order_status": "DRAFT PLACED PAID FULFILLED CANCELLED REFUNDED", "payment_status": "PENDING AUTHORISED CAPTURED FAILED REFUNDED", "shipment_status": "PREPARING IN_TRANSIT DELIVERED LOST RETURNED", "contact_kind": "BILLING TECHNICAL SUPPORT MARKETING",
}
#: The tables; columns are separated by commas, constraints stand after the bar.
TABLES = """
country: id int4!, iso_code bpchar(2)! U, country varchar(80)!, currency bpchar(3)!, calling_code varchar(6), created_at timestamptz!
region: id int4!, country_id int4! >country, region varchar(120)!, region_code varchar(10) | U country_id region
address: id int8!, region_id int4! >region, street_address varchar(180)!, address_line2 varchar(180), city varchar(120)!, postal_code varchar(16)!, latitude numeric(9.6), longitude numeric(9.6), created_at timestamptz!
customer: id int4!, public_ref uuid! U, first_name varchar(80)!, last_name varchar(80)!, email varchar(160)! U, phone varchar(32), date_of_birth date, national_id varchar(20), billing_address_id int8 >address, referred_by_id int4 >customer, primary_order_id int8 >order_header, marketing_opt_in bool!, lifetime_value numeric(12.2)!, tags text[], preferences jsonb!, last_login_ip inet, created_at timestamptz!, updated_at timestamptz! | C (lifetime_value >= (0)::numeric)
customer_contact: id int4!, customer_id int4! >customer, kind =contact_kind!, full_name varchar(160)!, email varchar(160)!, phone varchar(32), job_title varchar(80), is_primary bool!
employee: id int4!, manager_id int4 >employee, address_id int8 >address, first_name varchar(80)!, last_name varchar(80)!, full_name text G, work_email varchar(160)! U, department varchar(80)!, job_title varchar(80)!, hired_on date!, salary numeric(10.2), created_at timestamptz!
supplier: id int4!, address_id int8 >address, company varchar(160)!, contact_email varchar(160)!, contact_phone varchar(32), website varchar(200), iban varchar(34), active bool!, created_at timestamptz!
category: id int4!, parent_id int4 >category, title varchar(120)!, slug varchar(140)! U, description text
product: id int4!, category_id int4! >category, supplier_id int4! >supplier, product_name varchar(160)!, slug varchar(180)! U, description text, attributes jsonb!, discontinued bool!, created_at timestamptz!
product_variant: id int4!, product_id int4! >product, sku varchar(40)! U, variant_name varchar(120)!, weight_grams int4, unit_price numeric(10.2)!, currency bpchar(3)! | C (unit_price >= (0)::numeric)
warehouse: id int4!, address_id int8! >address, warehouse_code varchar(12)! U, title varchar(120)!, capacity int4!
inventory: warehouse_id int4! >warehouse, product_variant_id int4! >product_variant, quantity int4!, reserved int4!, reorder_level int4!, updated_at timestamptz! | P warehouse_id product_variant_id | C (quantity >= 0)
price_list: id int4!, country_id int4! >country, title varchar(120)!, currency bpchar(3)!, valid_from date!, valid_to date
price_list_entry: price_list_id int4! >price_list, product_variant_id int4! >product_variant, price numeric(10.2)!, discount_percent numeric(5.2)! | P price_list_id product_variant_id
promotion: id int4!, promo_code varchar(24)! U, title varchar(120)!, discount_percent numeric(5.2)!, starts_at timestamptz!, ends_at timestamptz, max_uses int4
order_header: id int8!, customer_id int4! >customer, billing_address_id int8! >address, shipping_address_id int8 >address, promotion_id int4 >promotion, order_number varchar(24)! U, status =order_status!, subtotal numeric(12.2)!, tax_amount numeric(12.2)!, grand_total numeric(12.2)!, currency bpchar(3)!, placed_at timestamptz, notes text, created_at timestamptz!
order_line: id int8!, order_id int8! >order_header, product_variant_id int4! >product_variant, line_number int4!, quantity int4!, unit_price numeric(10.2)!, line_total numeric(12.2)! | U order_id line_number | C (quantity > 0)
payment: id int8!, order_id int8! >order_header, status =payment_status!, amount numeric(12.2)!, currency bpchar(3)!, card_number varchar(19), cardholder_name varchar(160), processor_ref varchar(64)! U, client_ip inet, captured_at timestamptz, created_at timestamptz!
shipment: id int8!, order_id int8! >order_header, warehouse_id int4! >warehouse, status =shipment_status!, tracking_ref varchar(48) U, carrier varchar(60), shipped_at timestamptz, delivered_at timestamptz, weight_grams int4
shipment_item: shipment_id int8! >shipment, order_id int8!, line_number int4!, quantity int4! | P shipment_id order_id line_number | F fk_shipment_item_line order_id line_number > order_line
review: id int8!, product_id int4! >product, customer_id int4! >customer, rating int2!, title varchar(160), body text, helpful_votes int4!, created_at timestamptz! | U product_id customer_id | C ((rating >= 1) AND (rating <= 5))
audit_log: id int8!, employee_id int4 >employee, customer_id int4 >customer, action varchar(60)!, entity_type varchar(60)!, entity_id varchar(64)!, actor_email varchar(160), client_ip inet, user_agent text, detail jsonb!, occurred_at timestamptz!
"""
NAMED = {("customer", "primary_order_id"): "fk_customer_primary_order"}
COLUMN = re.compile(r"(\w+) (=?)(\w+?)(?:\((\d+)(?:\.(\d+))?\))?(\[\])?(!)?( U)?( G)?(?: >(\w+))?$")


def commerce(schema: str = "public") -> Schema:
    return parse(TABLES, schema)


def parse(text: str, schema: str, enums: dict[str, str] = ENUMS) -> Schema:
    tables = {}
    for line in text.strip().splitlines():
        name, rest = line.split(": ", 1)
        listed, *constraints = rest.split(" | ")
        rows = [COLUMN.match(c.strip()) for c in listed.split(", ")]
        key = next((tuple(c.split()[1:]) for c in constraints if c.startswith("P ")), ("id",))
        uniques = [(m[1],) for m in rows if m[8]] + [tuple(c.split()[1:]) for c in constraints if c.startswith("U ")]
        fks = [ForeignKey(NAMED.get((name, m[1]), f"{name}_{m[1]}_fkey"), name, (m[1],), m[10], ("id",)) for m in rows if m[10]]
        for c in constraints:
            if c.startswith("F "):
                left, parent = c[2:].split(" > ")
                fk, *columns = left.split()
                fks.append(ForeignKey(fk, name, tuple(columns), parent, tuple(columns)))
        foreign = {c for fk in fks for c in fk.columns}
        columns = tuple(
            Column(
                m[1], m[3], nullable=not m[7], length=int(m[4]) if m[4] and m[3] != "numeric" else None, precision=int(m[4]) if m[4] and m[3] == "numeric" else None, scale=int(m[5]) if m[5] else None,
                labels=tuple(enums[m[3]].split()) if m[2] else (), element=m[3] if m[6] else None, generated="concat_ws(' ', first_name, last_name)" if m[9] else None, data_class=classify(m[1], m[3], bool(m[2]), m[1] in key, m[1] in foreign),
            )
            for m in rows
        )
        checks = tuple(c[2:] for c in constraints if c.startswith("C "))
        tables[name] = Table(name, columns, key, tuple(sorted(uniques)), checks, tuple(sorted(fks, key=lambda f: f.name)))
    return Schema(schema, tables)


#: The declared foreign keys of the test tables.
TEST_EDGES = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"),
]
TEST_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

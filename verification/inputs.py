"""Messy business tables derived from the test tables, row by row, by plain SQL text.

The same text runs in Spark and in DuckDB; ``DIALECT`` holds the few spellings
that differ. Every source row gives one derived row: nothing is left out.
"""

from pyspark.sql import DataFrame, SparkSession

from recordmill.sources.tables import read_table

DIALECT = {
    "spark": {
        "ts": "TIMESTAMP_NTZ",
        "array": "array",
        "no_links": "cast(array() as array<string>)",
        "money": "format_string('$%,.2f', {0})",
    },
    "duckdb": {
        "ts": "TIMESTAMP",
        "array": "list_value",
        "no_links": "cast(list_value() as varchar[])",
        "money": "format('${{:,.2f}}', {0})",
    },
}

PAD = "lpad(cast({0} as string), 2, '0')"
YEAR = "cast(year(o_orderdate) as string)"
MONTH = PAD.format("month(o_orderdate)")
DAY = PAD.format("day(o_orderdate)")
MONTH_NAME = "substring('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate) - 2, 3)"

CLOSE_DATE = f"""case o_orderkey % 9
  when 0 then {YEAR} || '-' || {MONTH} || '-' || {DAY}
  when 1 then {MONTH} || '/' || {DAY} || '/' || {YEAR}
  when 2 then {MONTH} || '-' || {DAY} || '-' || {YEAR}
  when 3 then {DAY} || '/' || {MONTH} || '/' || {YEAR}
  when 4 then ' ' || {YEAR} || '/' || {MONTH} || '/' || {DAY}
  when 5 then {MONTH} || '/' || {YEAR}
  when 6 then {MONTH_NAME} || ' ' || {YEAR}
  when 7 then {YEAR} || '-02-30'
  else '' end"""

AMOUNT = """case o_orderkey % 4
  when 0 then cast(o_totalprice as string)
  when 1 then {money_price}
  when 2 then 'n/a'
  else '' end"""

COMPANY_NAME = """case when c_custkey % 101 = 0 then ''
  when c_custkey % 11 = 0 then '  ' || c_name || ' ' else c_name end"""

DOMAIN = """case c_custkey % 4
  when 0 then 'https://www.co' || cast(c_custkey as string) || '.com/pricing'
  when 1 then 'CO' || cast(c_custkey as string) || '.COM'
  when 2 then ' www.co' || cast(c_custkey as string) || '.com'
  else '' end"""

INDUSTRY = """case c_custkey % 7
  when 0 then c_mktsegment when 1 then 'Robotics' when 2 then 'Food & Beverage'
  when 3 then 'real estate' when 4 then ' R&D ' when 5 then 'Kite Tuning'
  else '' end"""

EMPLOYEES = """case c_custkey % 6
  when 0 then cast(c_custkey * 3 as string) when 1 then '1,234' when 2 then 'unknown'
  when 3 then '12.9' when 4 then '' else cast(c_custkey as string) || ' people' end"""

EMAIL = """case p_partkey % 6
  when 0 then 'p' || cast(p_partkey as string) || '@example.com'
  when 1 then '  P' || cast(p_partkey as string) || '@Example.COM '
  when 2 then 'not-an-email'
  when 3 then 'team' || cast(p_size as string) || '@example.com'
  when 4 then ''
  else 'p' || cast(p_partkey as string) || '@mail.example.org' end"""

PHONE = """case p_partkey % 4
  when 0 then '+1-555-' || lpad(cast(p_partkey as string), 6, '0')
  when 1 then '555.' || lpad(cast(p_partkey as string), 6, '0')
  when 2 then 'n/a' else '' end"""

LIFECYCLE = """case p_partkey % 5
  when 0 then 'subscriber' when 1 then ' Lead' when 2 then 'champion' when 3 then '' else 'CUSTOMER' end"""

LINE_KEY = """cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-'
  || cast(l_partkey as string) || '-' || cast(l_suppkey as string)"""

BODY = """case event_id % 5
  when 0 then '{"table": "Companies", "recordId": "recC' || cast(user_id as string)
    || '", "fields": {"company_name": "From payload"}}'
  when 1 then '{"table_name": "Line Items", "record": {"id": "recX' || cast(user_id as string)
    || '", "fields": {"product_name": "' || event_type || '", "quantity": 3, "unit_price": "$'
    || cast(value as string) || '", "deal_id": "D-' || cast(user_id as string) || '"}}}'
  when 2 then '{"tableName": "contacts", "id": "recP' || cast(user_id as string) || '"}'
  when 3 then '{"table": "' || case when event_type = 'view' then 'Invoices' else 'Deal' end
    || '", "recordId": "recD' || cast(user_id as string) || '", "eventId": "e' || cast(event_id as string) || '"}'
  else case event_type
    when 'error' then '{"table": "Companies", "recordId": ' || cast(user_id as string) || '}'
    when 'signup' then '{"table": "Companies", "recordId": "recGone' || cast(user_id as string) || '"}'
    when 'click' then 'no json at all'
    else '{"table": "", "table_name": "companies", "recordId": "recC' || cast(user_id as string) || '"}'
  end end"""

# name: (source table, select list)
INPUTS = {
    # --- CSV exports ---
    "csv_companies": ("customer", f"""
        cast(c_custkey as string) as company_id, {COMPANY_NAME} as company_name, {DOMAIN} as domain,
        {INDUSTRY} as industry, {EMPLOYEES} as number_of_employees"""),
    "csv_contacts": ("part", f"""
        cast(p_partkey as string) as contact_id, p_brand as first_name, p_type as last_name,
        {EMAIL} as email, {PHONE} as phone,
        case when p_partkey % 50 = 7 then '' else cast(p_partkey as string) end as company_id,
        {LIFECYCLE} as lifecycle_stage"""),
    "csv_deals": ("orders", f"""
        case when o_orderkey % 211 = 5 then '' else cast(o_orderkey as string) end as deal_id,
        case when o_orderkey % 89 = 0 then '' else 'Deal ' || cast(o_orderkey % 50 as string) end as deal_name,
        {AMOUNT} as amount,
        case o_orderstatus when 'F' then 'closedwon' when 'O' then 'Negotiation' else 'ContractSent' end
          as deal_stage,
        {CLOSE_DATE} as close_date,
        cast(case when o_orderkey % 7 = 0 then 5 when o_orderkey % 97 = 0 then o_custkey + 10000000 else o_custkey end as string)
          as company_id,
        cast(o_custkey as string) as contact_id"""),
    # --- record tables ---
    "rec_companies": ("customer", f"""
        'recC' || cast(c_custkey as string) as record_id,
        {{ts}} '2024-01-01 00:00:00' + interval '1' minute * c_custkey as last_modified,
        case when c_custkey % 5 > 0 then '' when c_custkey % 10 = 0 then 'X' || cast(c_custkey as string)
          else 'T' || cast(c_custkey as string) end as hubspot_record_id,
        case when c_custkey % 103 = 0 then '' else 'C-' || cast(c_custkey as string) end as company_id,
        case when c_custkey % 103 = 0 then '' else {COMPANY_NAME} end as company_name,
        case when c_custkey % 103 = 0 then '' else {DOMAIN} end as domain,
        case when c_custkey % 103 = 0 then '' else {INDUSTRY} end as industry,
        case when c_custkey % 103 = 0 then '' else {EMPLOYEES} end as number_of_employees"""),
    "rec_contacts": ("part", f"""
        'recP' || cast(p_partkey as string) as record_id,
        {{ts}} '2024-01-01 00:00:00' + interval '1' minute * p_partkey as last_modified,
        case when p_partkey % 6 = 0 then 'TP' || cast(p_partkey as string) else '' end as hubspot_record_id,
        'P-' || cast(p_partkey as string) as contact_id, p_brand as first_name, p_type as last_name,
        {EMAIL} as email, {PHONE} as phone,
        case when p_partkey % 4 = 3 then '' else 'C-' || cast(p_partkey as string) end as company_id,
        case p_partkey % 4
          when 0 then {{array}}('recC' || cast(p_partkey as string))
          when 2 then {{array}}('recC' || cast(case when p_partkey % 8 = 2 then 5 else p_partkey end as string), 'recC1')
          else {{no_links}} end as Company"""),
    "rec_deals": ("orders", f"""
        'recD' || cast(o_orderkey as string) as record_id, o_orderdate as last_modified,
        case when o_orderkey % 3 = 0 then 'TD' || cast(o_orderkey as string) else '' end as hubspot_record_id,
        'D-' || cast(o_orderkey as string) as deal_id,
        case when o_orderkey % 89 = 0 then '' else 'Deal ' || cast(o_orderkey % 50 as string) end as deal_name,
        {AMOUNT} as amount,
        case o_orderstatus when 'F' then 'Closed-Won' when 'O' then ' LOST' else 'In Progress' end as status,
        {CLOSE_DATE} as close_date, 'C-' || cast(o_custkey as string) as company_id,
        case when o_orderkey % 2 = 0 then {{array}}('recC' || cast(case when o_orderkey % 6 = 0 then 5 else o_custkey end as string))
          else {{no_links}} end as Company"""),
    "rec_lines": ("lineitem", f"""
        'recL' || {LINE_KEY} as record_id, l_shipdate as last_modified, '' as hubspot_record_id,
        case when l_partkey % 97 = 0 then '' else 'Item ' || cast(l_partkey as string) end as product_name,
        cast(l_quantity as string) as quantity, {{money_line}} as unit_price,
        case when l_suppkey % 13 = 5 then 'D-none' else 'D-' || cast(l_orderkey as string) end as deal_id,
        case when l_linenumber = 2 then {{array}}('recD' || cast(l_orderkey as string))
          else {{no_links}} end as Deal"""),
    # --- target snapshots: found by external id, by natural key, or not at all ---
    "target_companies": ("customer", """
        'T' || cast(c_custkey as string) as id, 'Old ' || c_name as name,
        case when c_custkey % 3 = 1 then 'co' || cast(c_custkey as string) || '.com'
          else 'other' || cast(c_custkey as string) || '.org' end as domain,
        'RETAIL' as industry, '7' as numberofemployees,
        case c_custkey % 3 when 0 then '{prefix}companies:{rec_c}' || cast(c_custkey as string)
          when 2 then 'manual:companies:' || cast(c_custkey as string) end as external_source_id,
        case c_custkey % 3 when 1 then null else 'csv_migration' end as external_source_system"""),
    "target_contacts": ("part", """
        'TP' || cast(p_partkey as string) as id, 'Old' as firstname, 'Name' as lastname,
        case when p_partkey % 3 = 1 then 'p' || cast(p_partkey as string) || '@example.com'
          else 'old' || cast(p_partkey as string) || '@example.net' end as email,
        '000' as phone, 'lead' as lifecyclestage,
        case p_partkey % 3 when 0 then '{prefix}contacts:{rec_p}' || cast(p_partkey as string)
          when 2 then 'manual:contacts:' || cast(p_partkey as string) end as external_source_id,
        case p_partkey % 3 when 1 then null else 'csv_migration' end as external_source_system"""),
    "target_deals": ("orders", """
        'TD' || cast(o_orderkey as string) as id, 'Old deal' as dealname, '1' as amount,
        'qualifiedtobuy' as dealstage, '2000-01-01' as closedate, 'default' as pipeline,
        case o_orderkey % 4 when 1 then '{prefix}deals:{rec_d}' || cast(o_orderkey as string)
          else 'manual:deals:' || cast(o_orderkey as string) end as external_source_id,
        'csv_migration' as external_source_system"""),
    "target_lines": ("lineitem", f"""
        'TL' || {LINE_KEY} as id, 'Old line' as name, '1' as quantity, '1' as price,
        case when l_linenumber % 2 = 0 then 'airtable:line_items:recL' || {LINE_KEY}
          else 'manual:line_items:' || {LINE_KEY} end as external_source_id,
        'airtable' as external_source_system"""),
    # --- change events ---
    "event_bodies": ("events", f"event_id, ts, user_id, event_type, value, {{body}} as body"),
}

CSV_IDS = {"prefix": "csv:", "rec_c": "", "rec_p": "", "rec_d": ""}
RECORD_IDS = {"prefix": "airtable:", "rec_c": "recC", "rec_p": "recP", "rec_d": "recD"}


def select_list(name: str, dialect: str, ids: dict[str, str]) -> str:
    words = dict(DIALECT[dialect])
    money = words.pop("money")
    text = INPUTS[name][1]
    words |= {"money_price": money.format("o_totalprice"), "money_line": money.format("l_extendedprice"),
              "body": BODY, **ids}
    for word, value in words.items():
        text = text.replace("{%s}" % word, value)
    return text


def derived(spark: SparkSession, sf_dir: str, name: str, ids: dict[str, str] = CSV_IDS) -> DataFrame:
    """A derived table in Spark."""
    table = read_table(spark, f"{sf_dir}/{INPUTS[name][0]}.parquet", spark.sparkContext.defaultParallelism)
    table.createOrReplaceTempView("_derived_from")
    return spark.sql(f"select {select_list(name, 'spark', ids)} from _derived_from")


def cte(name: str, ids: dict[str, str] = CSV_IDS) -> str:
    """The same table as a common table expression for DuckDB."""
    return f"{name} as (select {select_list(name, 'duckdb', ids)} from {INPUTS[name][0]})"

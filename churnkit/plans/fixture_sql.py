"""DuckDB text of the four fixtures (FIXTURES.md section 2), used by the oracle SQL."""

FX1 = """
with r as (
  select o_custkey, o_orderdate, o_totalprice, o_orderpriority, o_orderstatus,
         row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
  from orders),
g as (
  select o_custkey,
         cast((2001 - year(min(o_orderdate))) * 12 + (8 - month(min(o_orderdate))) as int) as tenure,
         cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total_charges,
         max(case when rn = 1 then o_totalprice end) as monthly_charges,
         max(case when rn = 1 then o_orderpriority end) as last_priority,
         max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as s1,
         max(case when o_orderpriority = '2-HIGH' then 1 else 0 end) as s2,
         max(case when o_orderpriority = '3-MEDIUM' then 1 else 0 end) as s3,
         max(case when o_orderpriority = '4-NOT SPECIFIED' then 1 else 0 end) as s4,
         max(case when o_orderpriority = '5-LOW' then 1 else 0 end) as s5,
         max(case when o_orderstatus = 'P' and rn <= 2 then 1 else 0 end) as s6,
         case when max(o_orderdate) < timestamp '2001-03-01 00:00:00' then 'Yes' else 'No' end as churn
  from r group by o_custkey)
select c_custkey as customer_id,
       case when c_custkey % 97 = 0 then 'Other' when c_custkey % 2 = 0 then 'Male' else 'Female' end as gender,
       case when c_custkey % 7 = 0 then 1 else 0 end as senior_citizen,
       case when c_custkey % 3 = 0 then 'Yes' else 'No' end as partner,
       case when c_custkey % 4 = 0 then 'Yes' else 'No' end as dependents,
       case when c_custkey % 10 = 0 then 'No' else 'Yes' end as phone_service,
       case when c_custkey % 10 = 0 then 'No phone service' when c_custkey % 3 = 1 then 'Yes' else 'No' end as multiple_lines,
       case when c_nationkey % 5 = 0 then 'No' when c_nationkey % 5 <= 2 then 'Fiber optic' else 'DSL' end as internet_service,
       case when c_acctbal >= 5000 then 'Yes' else 'No' end as paperless_billing,
       coalesce(tenure, 0) as tenure,
       monthly_charges,
       case when c_custkey % 50 = 0 then ' ' else cast(cast(total_charges as decimal(18,2)) as varchar(30)) end as total_charges_raw,
       case when c_mktsegment in ('BUILDING','AUTOMOBILE') then 'Month-to-month'
            when c_mktsegment in ('MACHINERY','FURNITURE') then 'One year' else 'Two year' end as contract,
       case when last_priority in ('1-URGENT','2-HIGH') then 'Electronic check'
            when last_priority = '3-MEDIUM' then 'Mailed check'
            when last_priority = '4-NOT SPECIFIED' then 'Bank transfer (automatic)'
            else 'Credit card (automatic)' end as payment_method,
       case when c_nationkey % 5 = 0 then 'No internet service' when s1 = 1 then 'Yes' else 'No' end as online_security,
       case when c_nationkey % 5 = 0 then 'No internet service' when s2 = 1 then 'Yes' else 'No' end as online_backup,
       case when c_nationkey % 5 = 0 then 'No internet service' when s3 = 1 then 'Yes' else 'No' end as tech_support,
       case when c_nationkey % 5 = 0 then 'No internet service' when s4 = 1 then 'Yes' else 'No' end as device_protection,
       case when c_nationkey % 5 = 0 then 'No internet service' when s5 = 1 then 'Yes' else 'No' end as streaming_tv,
       case when c_nationkey % 5 = 0 then 'No internet service' when s6 = 1 then 'Yes' else 'No' end as streaming_movies,
       coalesce(churn, 'Yes') as churn
from customer left join g on c_custkey = o_custkey
"""

FX2 = """
with p as (
  select o_custkey, o_totalprice, o_orderstatus, o_orderpriority,
         case year(o_orderdate) when 1998 then 6 when 1999 then 7 when 2000 then 8 when 2001 then 9 end as ph
  from orders),
w as (
  select o_custkey,
    cast(sum(case when ph=6 and o_orderpriority='1-URGENT' then 1 end) as double) as total_rech_data_6,
    max(case when ph=6 and o_orderpriority='1-URGENT' then o_totalprice end) as av_rech_amt_data_6,
    cast(sum(case when ph=7 and o_orderpriority='1-URGENT' then 1 end) as double) as total_rech_data_7,
    max(case when ph=7 and o_orderpriority='1-URGENT' then o_totalprice end) as av_rech_amt_data_7,
    cast(sum(case when ph=6 and o_orderpriority='5-LOW' then 1 when ph=6 then 0 end) as double) as vol_3g_mb_6,
    cast(sum(case when ph=7 and o_orderpriority='5-LOW' then 1 when ph=7 then 0 end) as double) as vol_3g_mb_7,
    cast(sum(case when ph=8 and o_orderpriority='5-LOW' then 1 when ph=8 then 0 end) as double) as vol_3g_mb_8,
    cast(sum(case when ph=9 and o_orderpriority='5-LOW' then 1 when ph=9 then 0 end) as double) as vol_3g_mb_9,
    max(case when ph=6 and o_orderpriority='2-HIGH' then 1.0e0 end) as fb_user_6,
    max(case when ph=7 and o_orderpriority='2-HIGH' then 1.0e0 end) as fb_user_7,
    max(case when ph=8 and o_orderpriority='2-HIGH' then 1.0e0 end) as fb_user_8,
    cast(sum(case when ph=6 then cast(o_totalprice as decimal(18,2)) end) as double) as total_rech_amt_6,
    cast(sum(case when ph=7 then cast(o_totalprice as decimal(18,2)) end) as double) as total_rech_amt_7,
    cast(sum(case when ph=8 then cast(o_totalprice as decimal(18,2)) end) as double) as total_rech_amt_8,
    cast(sum(case when ph=9 then cast(o_totalprice as decimal(18,2)) end) as double) as total_rech_amt_9,
    cast(sum(case when ph=6 and o_orderstatus='F' then 1 when ph=6 then 0 end) as double) as total_ic_mou_6,
    cast(sum(case when ph=7 and o_orderstatus='F' then 1 when ph=7 then 0 end) as double) as total_ic_mou_7,
    cast(sum(case when ph=8 and o_orderstatus='F' then 1 when ph=8 then 0 end) as double) as total_ic_mou_8,
    cast(sum(case when ph=9 and o_orderstatus='F' then 1 when ph=9 then 0 end) as double) as total_ic_mou_9,
    cast(sum(case when ph=6 and o_orderstatus='O' then 1 when ph=6 then 0 end) as double) as total_og_mou_6,
    cast(sum(case when ph=7 and o_orderstatus='O' then 1 when ph=7 then 0 end) as double) as total_og_mou_7,
    cast(sum(case when ph=8 and o_orderstatus='O' then 1 when ph=8 then 0 end) as double) as total_og_mou_8,
    cast(sum(case when ph=9 and o_orderstatus='O' then 1 when ph=9 then 0 end) as double) as total_og_mou_9,
    cast(sum(case when ph=6 and o_orderstatus='P' then 1 when ph=6 then 0 end) as double) as vol_2g_mb_6,
    cast(sum(case when ph=7 and o_orderstatus='P' then 1 when ph=7 then 0 end) as double) as vol_2g_mb_7,
    cast(sum(case when ph=8 and o_orderstatus='P' then 1 when ph=8 then 0 end) as double) as vol_2g_mb_8,
    cast(sum(case when ph=9 and o_orderstatus='P' then 1 when ph=9 then 0 end) as double) as vol_2g_mb_9
  from p group by o_custkey)
select c_custkey as customer_id, total_rech_amt_6, total_rech_amt_7, total_rech_amt_8, total_rech_amt_9,
       total_ic_mou_6, total_ic_mou_7, total_ic_mou_8, total_ic_mou_9,
       total_og_mou_6, total_og_mou_7, total_og_mou_8, total_og_mou_9,
       vol_2g_mb_6, vol_2g_mb_7, vol_2g_mb_8, vol_2g_mb_9,
       total_rech_data_6, av_rech_amt_data_6, total_rech_data_7, av_rech_amt_data_7,
       vol_3g_mb_6, vol_3g_mb_7, vol_3g_mb_8, vol_3g_mb_9,
       fb_user_6, fb_user_7, fb_user_8
from customer left join w on c_custkey = o_custkey
"""

FX3 = """
select o_orderkey as id,
       case when o_orderstatus = 'F' then 1 else 0 end as label,
       cast((o_orderkey * 7919 + 104729) % 701
            + case when o_orderstatus = 'F' then 300 else 0 end as double) / 1000 as prob
from orders
"""

FX4 = """
select concat('batch_', cast(year(o_orderdate) as varchar(4))) as batch_id,
       o_custkey as customer_id, o_orderkey as id, o_orderdate as ts,
       cast((o_orderkey * 7919 + 104729) % 1001 as double) / 1000 as churn_probability,
       case o_orderstatus when 'O' then 'pending' when 'P' then 'contacted' else 'resolved' end as status
from orders
"""

# FX1 under the account-snapshot column names of the reference.
ACC = """
select customer_id as "customerID", gender, senior_citizen as "SeniorCitizen",
       partner as "Partner", dependents as "Dependents", tenure,
       phone_service as "PhoneService", multiple_lines as "MultipleLines",
       internet_service as "InternetService", online_security as "OnlineSecurity",
       online_backup as "OnlineBackup", device_protection as "DeviceProtection",
       tech_support as "TechSupport", streaming_tv as "StreamingTV",
       streaming_movies as "StreamingMovies", contract as "Contract",
       paperless_billing as "PaperlessBilling", payment_method as "PaymentMethod",
       monthly_charges as "MonthlyCharges", total_charges_raw as "TotalCharges",
       churn as "Churn"
from fx1
"""

_BODIES = {"fx1": FX1, "fx2": FX2, "fx3": FX3, "fx4": FX4, "acc": ACC}
_NEEDS = {"acc": ["fx1"]}


def with_fx(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` the named fixtures (and dependencies), then extra CTEs, then ``body``."""
    order: list[str] = []

    def add(n):
        for d in _NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} as ({_BODIES[n].strip()})" for n in order]
    ctes += [f"{n} as ({b.strip()})" for n, b in (extra or [])]
    return ("with " + ",\n".join(ctes) + "\n" + body.strip()) if ctes else body.strip()

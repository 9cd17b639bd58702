"""SQL that answers every registered query over the plain tables."""

from __future__ import annotations

from streamscore.plans.fixtures import AS_OF, BATCHES, CREATED_AT
from streamscore.schemas import CAMPAIGNS

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"

_FIXTURES = f"""
fx_base as (
  select 'E' || lpad(cast(event_id as varchar), cast(greatest(8, length(cast(event_id as varchar))) as int), '0') as event_id,
         'U' || lpad(cast(user_id as varchar), cast(greatest(4, length(cast(user_id as varchar))) as int), '0') as user_id,
         case when event_type in ('view', 'error') then 'IM'
              when event_type = 'click' then 'CL'
              when event_type = 'signup' then 'PS'
              when {_K} < 7 then 'CN'
              else 'CL' end as event_type,
         'C00' || cast({_K} % 7 + 1 as varchar) as campaign_id,
         ts as event_ts, value, event_id as n, {_K} as k
  from events),
fx_marketing as (
  select event_id, user_id, event_type, campaign_id, event_ts, n, k
  from fx_base where event_type <> 'CN'
  union all
  select event_id, user_id, event_type, campaign_id, event_ts - interval 1 minute, n, k
  from fx_base where event_type <> 'CN' and n % 10 = 0),
fx_conversion as (
  select event_id, user_id, event_type, campaign_id, event_ts, value as conversion_value, n, k
  from fx_base where event_type = 'CN'
  union all
  select event_id, user_id, event_type, campaign_id, event_ts - interval 1 hour, value + 1, n, k
  from fx_base where event_type = 'CN' and n % 5 = 0),
dim_campaigns as (
  select * from (values {", ".join(f"('{i}', '{n}', '{c}', '{a}', timestamp '{CREATED_AT}')" for i, n, c, a in CAMPAIGNS)})
  as t(campaign_id, campaign_name, channel, advertiser, created_at)),
both_tables as (
  select event_id, user_id, event_type, campaign_id, event_ts, cast(null as double) as conversion_value
  from fx_marketing
  union all
  select event_id, user_id, event_type, campaign_id, event_ts, conversion_value from fx_conversion),
unified as (
  select event_id, user_id, event_type, campaign_id, event_ts, conversion_value
  from (select *, row_number() over (partition by event_id
          order by event_ts desc, conversion_value desc nulls last, event_type desc) as rn
        from both_tables) where rn = 1),
ev as (
  select e.event_id, e.user_id, e.event_type, e.campaign_id, c.campaign_name, c.channel,
         e.event_ts, e.conversion_value
  from unified e left join dim_campaigns c on e.campaign_id = c.campaign_id)"""

AS_OF_SQL = f"timestamp '{AS_OF}'"


def _windowed(as_of: str) -> str:
    def count(condition: str, hours: int, name: str) -> str:
        return (
            f"cast(sum(case when {condition} and event_ts >= {as_of} - interval {hours} hour "
            f"then 1 else 0 end) as bigint) as {name}"
        )

    columns = [
        count("event_type = 'CL'", 1, "clicks_1h"),
        count("event_type = 'CL'", 24, "clicks_24h"),
        count("event_type = 'CL'", 168, "clicks_7d"),
        count("event_type = 'IM'", 1, "impressions_1h"),
        count("event_type = 'IM'", 24, "impressions_24h"),
        count("event_type = 'PS'", 1, "paid_search_1h"),
        count("event_type = 'PS'", 24, "paid_search_24h"),
        count("event_type = 'CN'", 168, "conversions_7d"),
        count("true", 24, "event_count_24h"),
    ]
    return (
        f"select user_id, {', '.join(columns)} from ev "
        f"where event_ts >= {as_of} - interval 168 hour and event_ts <= {as_of} group by user_id"
    )


_Z = """(-2.1 + 0.8 * cast(coalesce(clicks_1h, 0) as double) + 0.4 * cast(coalesce(clicks_24h, 0) as double)
  + 0.1 * cast(coalesce(clicks_7d, 0) as double) + 0.3 * cast(coalesce(impressions_1h, 0) as double)
  + 0.15 * cast(coalesce(impressions_24h, 0) as double) + 0.2 * cast(coalesce(paid_search_1h, 0) as double)
  + 1.2 * cast(coalesce(paid_search_24h, 0) as double) + 2.5 * cast(coalesce(conversions_7d, 0) as double))"""
_SCORE = f"1.0 / (1.0 + exp(-cast({_Z} as double)))"
_BUCKET = "case when propensity_score >= 0.7 then 'HIGH' when propensity_score >= 0.4 then 'MED' else 'LOW' end"

_SCORES = f""",
rolling as ({_windowed(AS_OF_SQL)}),
scores as (
  select user_id, propensity_score, {_BUCKET} as score_bucket, {AS_OF_SQL} as last_updated
  from (select user_id, {_SCORE} as propensity_score from rolling))"""


def _delta(source: str, as_of: str) -> str:
    def count(code: str, hours: int | None) -> str:
        bound = f" and event_ts >= {as_of} - interval {hours} hour" if hours else ""
        return f"cast(sum(case when event_type = '{code}'{bound} then 1 else 0 end) as bigint)"

    parts = []
    for kind, code in (("clicks", "CL"), ("impressions", "IM"), ("paid_search", "PS")):
        parts += [
            f"{count(code, 1)} as {kind}_1h",
            f"{count(code, 24)} as {kind}_24h",
            f"{count(code, None)} as {kind}_7d",
        ]
    return (
        f"select user_id, {', '.join(parts)}, {count('CN', None)} as conversions, "
        "max(case when event_type = 'CN' then event_ts end) as latest_conversion_ts, "
        f"count(*) as batch_event_count from {source} group by user_id"
    )


def _batch_filter(batch: int) -> str:
    start, end, _ = BATCHES[batch]
    conditions = [f"event_ts >= timestamp '{start}'"] if start else []
    conditions += [f"event_ts < timestamp '{end}'"] if end else []
    return f"(select * from ev where {' and '.join(conditions)})"


def _merge(state: str | None, delta: str, as_of: str) -> str:
    kinds = ("clicks", "impressions", "paid_search")
    if state is None:
        counts = ", ".join(f"{k}_1h, {k}_24h, {k}_7d" for k in kinds)
        return f"""
  select user_id, {counts}, conversions as conversions_total,
         latest_conversion_ts as last_conversion_ts,
         cast(date_diff('hour', coalesce(latest_conversion_ts, {as_of}), {as_of}) as double)
           as time_since_last_conversion_hrs,
         cast(batch_event_count as double) as event_velocity_24h, {as_of} as last_updated
  from {delta}"""
    new, known = "s.user_id is not null", "t.user_id is not null"
    columns = []
    for k in kinds:
        for span in ("1h", "24h"):
            columns.append(f"case when {new} then s.{k}_{span} else t.{k}_{span} end as {k}_{span}")
        columns.append(f"coalesce(t.{k}_7d, 0) + coalesce(s.{k}_7d, 0) as {k}_7d")
    last = "coalesce(s.latest_conversion_ts, t.last_conversion_ts)"
    return f"""
  select coalesce(t.user_id, s.user_id) as user_id, {", ".join(columns)},
         coalesce(t.conversions_total, 0) + coalesce(s.conversions, 0) as conversions_total,
         {last} as last_conversion_ts,
         case when s.user_id is null then t.time_since_last_conversion_hrs
              when {known} then cast(date_diff('hour', {last}, {as_of}) as double)
              else cast(date_diff('hour', coalesce(s.latest_conversion_ts, {as_of}), {as_of}) as double)
         end as time_since_last_conversion_hrs,
         case when s.user_id is null then t.event_velocity_24h
              when {known} then cast(s.batch_event_count as double)
                   / greatest(date_diff('hour', t.last_updated, {as_of}), 1)
              else cast(s.batch_event_count as double) end as event_velocity_24h,
         case when {new} then {as_of} else t.last_updated end as last_updated
  from {state} t full join {delta} s on t.user_id = s.user_id"""


def _clock(batch: int) -> str:
    return f"timestamp '{BATCHES[batch][2]}'"


_STATES = "".join(
    f""",
delta_{b} as ({_delta(_batch_filter(b), _clock(b))}),
state_{b} as ({_merge(f"state_{b - 1}" if b else None, f"delta_{b}", _clock(b))})"""
    for b in range(len(BATCHES))
) + f""",
features as (select * from state_{len(BATCHES) - 1})"""

_MONEY = "cast({} as decimal(38,10))"
_REVENUE = (
    "cast(sum(case when event_type = 'CN' then cast(conversion_value as decimal(38,10)) else 0 end) as double)"
)


def _count(code: str) -> str:
    return f"cast(sum(case when event_type = '{code}' then 1 else 0 end) as bigint)"


_PERFORMANCE = f""",
performance as (
  select campaign_id, campaign_name, channel, date_trunc('hour', event_ts) as hour_ts,
         count(*) as total_events, {_count('IM')} as impressions, {_count('CL')} as clicks,
         {_count('CN')} as conversions, {_REVENUE} as revenue,
         count(distinct user_id) as unique_users
  from ev group by all)"""

_SUMMARY = _PERFORMANCE + """,
summary as (
  select campaign_name, channel, cast(sum(impressions) as bigint) as impressions,
         cast(sum(clicks) as bigint) as clicks, cast(sum(conversions) as bigint) as conversions,
         cast(sum(cast(revenue as decimal(38,10))) as double) as revenue,
         cast(sum(clicks) as double) / nullif(cast(sum(impressions) as double), 0) as ctr,
         cast(sum(conversions) as double) / nullif(cast(sum(clicks) as double), 0) as conv_rate
  from performance group by campaign_name, channel)"""

_REACH = """,
reach as (
  select campaign_id, campaign_name, channel, user_id, count(*) as frequency,
         min(event_ts) as first_touch, max(event_ts) as last_touch,
         count(distinct date_trunc('hour', event_ts)) as active_hours
  from ev where event_type in ('CL', 'IM') group by 1, 2, 3, 4)"""

_JOURNEYS = f""",
numbered as (
  select user_id, event_id, event_ts, channel, campaign_name, event_type,
         row_number() over (partition by user_id order by event_ts, event_id) - 1 as touch_idx
  from ev),
totals as (
  select user_id, count(*) as touchpoint_count,
         max(case when event_type = 'CN' then 1 else 0 end) as converted,
         {_REVENUE} as conversion_value
  from ev group by user_id having max(case when event_type = 'CN' then 1 else 0 end) = 1),
touches as (
  select n.*, t.touchpoint_count, t.converted, t.conversion_value
  from numbered n join totals t on n.user_id = t.user_id)"""

_ATTRIBUTION = _JOURNEYS + """,
first_touch as (
  select channel, count(*) as conversions, sum(conversion_value) as attributed_revenue
  from touches where touch_idx = 0 group by channel),
last_touch as (
  select channel, count(*) as conversions, sum(conversion_value) as attributed_revenue
  from touches where touch_idx = touchpoint_count - 1 group by channel),
linear as (
  select channel, count(distinct user_id) as conversions,
         sum(conversion_value / touchpoint_count) as attributed_revenue
  from touches where event_type <> 'CN' group by channel),
weighted as (
  select *, exp(-0.5 * (touchpoint_count - touch_idx - 1)) as raw_weight
  from touches where event_type <> 'CN'),
time_decay as (
  select channel, count(distinct user_id) as conversions, sum(credit) as attributed_revenue
  from (select channel, user_id,
               conversion_value * raw_weight / sum(raw_weight) over (partition by user_id) as credit
        from weighted)
  group by channel)"""


def _attribution(model: str) -> str:
    return _query(
        f"""select channel, conversions, round(attributed_revenue, 6) as attributed_revenue,
       case when sum(attributed_revenue) over () > 0
            then round(attributed_revenue / sum(attributed_revenue) over () * 100, 1)
            else 0 end as credit_pct
from {model}""",
        _ATTRIBUTION,
    )


def _comparison() -> str:
    models = ["first_touch", "last_touch", "linear", "time_decay"]
    shares = "".join(
        f""",
pct_{m} as (select channel, round(attributed_revenue / sum(attributed_revenue) over () * 100, 1) as pct
  from {m})"""
        for m in models
    )
    columns = ", ".join(f"coalesce(pct_{m}.pct, 0) as {m}" for m in models)
    joins = " ".join(f"left join pct_{m} on pct_{m}.channel = listed.channel" for m in models)
    return _query(
        f"""select listed.channel, {columns}
from (values ('display'), ('search'), ('social'), ('email')) as listed(channel) {joins}""",
        _ATTRIBUTION + shares,
    )


def _query(body: str, *ctes: str) -> str:
    return f"with {_FIXTURES.strip()}{''.join(ctes)}\n{body}"


_SEGMENT = """
  from features f join scores p on f.user_id = p.user_id
  where p.propensity_score >= 0.2 and f.clicks_7d > 5 and p.score_bucket != 'HIGH'"""

_DEVICE = "case k % 3 when 0 then 'mobile' when 1 then 'desktop' else 'tablet' end"
_CHANNEL = "case k % 5 when 0 then 'search' when 1 then 'social' when 2 then 'display' when 3 then 'video' else 'email' end"
_ORDER = "case k % 2 when 0 then 'new' else 'repeat' end"


def _health(table: str, topic: str) -> str:
    return f"""
  select '{topic}' as topic, cast(n % 4 as int) as partition, n as "offset",
         case when n % 50 = 0 then 'bad event_ts'
              when n % 75 = 1 then 'missing event_id'
              when n % 90 = 2 then 'not a JSON object' end as error
  from {table}"""


_HISTORY = ", ".join(
    f"cast(count(*) filter (where {cond}) over "
    f"(partition by user_id order by event_ts range between interval {hours} hour preceding and current row) as bigint) as {name}"
    for name, cond, hours in [
        ("clicks_1h", "event_type = 'CL'", 1),
        ("clicks_24h", "event_type = 'CL'", 24),
        ("clicks_7d", "event_type = 'CL'", 168),
        ("impressions_1h", "event_type = 'IM'", 1),
        ("impressions_24h", "event_type = 'IM'", 24),
        ("paid_search_1h", "event_type = 'PS'", 1),
        ("paid_search_24h", "event_type = 'PS'", 24),
        ("conversions_7d", "event_type = 'CN'", 168),
        ("event_count_24h", "true", 24),
    ]
)

# One scored log per refresh: scores at the refresh's clock, features after it.
_LOG = "".join(
    f""",
rolling_{b} as ({_windowed(_clock(b))}),
scores_{b} as (select user_id, {_SCORE} as propensity_score from rolling_{b})"""
    for b in range(len(BATCHES))
) + """,
inference_log as (""" + " union all ".join(
    f"""
  select p.user_id, p.propensity_score as predicted_score,
         cast(case when p.propensity_score >= 0.5 then 1 else 0 end as int) as predicted_label,
         cast(case when f.conversions_total > 0 then 1 else 0 end as int) as actual_converted,
         {_clock(b)} as scored_at, 'V1' as model_version
  from scores_{b} p join state_{b} f on p.user_id = f.user_id"""
    for b in range(len(BATCHES))
) + ")"

_MONITOR = """,
binned as (
  select date_trunc('day', scored_at) as day, predicted_score, predicted_label, actual_converted,
         least(cast(floor(predicted_score * 10) as int), 9) as bin
  from inference_log),
days as (select distinct day from binned),
bins as (select unnest(range(10)) as bin),
shares as (
  select d.day, b.bin,
         count(x.day) as n, sum(count(x.day)) over (partition by d.day) as total
  from days d cross join bins b left join binned x on x.day = d.day and x.bin = b.bin
  group by d.day, b.bin),
drift as (
  select s.day, sum((s.p - b.p) * ln(s.p / b.p)) as psi
  from (select day, bin, greatest(cast(n as double) / cast(total as double), 0.0001) as p from shares) s
  join (select bin, greatest(cast(n as double) / cast(total as double), 0.0001) as p from shares
        where day = (select min(day) from days)) b on s.bin = b.bin
  group by s.day),
confusion as (
  select day, count(*) as rows_scored,
         cast(count(*) filter (where predicted_label = 1 and actual_converted = 1) as bigint) as true_positives,
         cast(count(*) filter (where predicted_label = 1 and actual_converted = 0) as bigint) as false_positives,
         cast(count(*) filter (where predicted_label = 0 and actual_converted = 0) as bigint) as true_negatives,
         cast(count(*) filter (where predicted_label = 0 and actual_converted = 1) as bigint) as false_negatives,
         round(avg(predicted_score), 6) as mean_score,
         avg(cast(predicted_label as double)) as predicted_positive_rate,
         avg(cast(actual_converted as double)) as actual_positive_rate
  from binned group by day)"""


def _build() -> dict[str, str]:
    sql = {}

    # Ingest
    sql["ingest_marketing"] = _query(
        f"""select event_id, user_id, event_type, campaign_id, event_ts,
       {_CHANNEL} as channel, {_DEVICE} as device, timestamp '{AS_OF}' as _ingested_at
from fx_marketing"""
    )
    sql["ingest_conversion"] = _query(
        f"""select event_id, user_id, event_type, campaign_id, event_ts, conversion_value,
       {_ORDER} as order_type from fx_conversion"""
    )
    sql["ingest_envelope"] = _query(
        f"""select event_id, user_id, event_type, campaign_id, event_ts,
       cast(null as double) as conversion_value, 'marketing_events' as topic,
       cast(n % 4 as int) as partition, n as "offset"
from fx_marketing where n % 50 <> 0 and n % 75 <> 1 and n % 90 <> 2
union all
select event_id, user_id, event_type, campaign_id, event_ts, conversion_value, 'conversion_events',
       cast(n % 4 as int), n
from fx_conversion where n % 50 <> 0 and n % 75 <> 1 and n % 90 <> 2"""
    )
    sql["ingest_start_position"] = _query(
        f"""select cast(n % 4 as int) as partition, count(*) as messages, min(n) as first_offset
from fx_marketing where n >= 100 and event_ts >= timestamp '{BATCHES[0][2]}' group by 1"""
    )
    sql["ingest_quarantine"] = _query(
        f"""select topic, error, count(*) as bad_rows
from ({_health('fx_marketing', 'marketing_events')} union all
      {_health('fx_conversion', 'conversion_events')})
where error is not null group by topic, error"""
    )
    sql["ingest_health"] = _query(
        f"""select topic, partition, max("offset") as committed_offset,
       cast(count(*) filter (where error is null) as bigint) as rows_inserted,
       cast(count(*) filter (where error is not null) as bigint) as rows_error,
       max_by(error, "offset") filter (where error is not null) as last_error
from ({_health('fx_marketing', 'marketing_events')} union all
      {_health('fx_conversion', 'conversion_events')})
group by topic, partition"""
    )
    sql["extract_properties"] = _query(
        f"""select event_id, event_ts, {_CHANNEL} as channel, {_DEVICE} as device,
       cast(null as varchar) as order_type from fx_marketing
union all
select event_id, event_ts, null, null, {_ORDER} from fx_conversion"""
    )
    sql["load_campaigns"] = _query(
        """select d.*, count(e.event_id) as events
from dim_campaigns d left join unified e on d.campaign_id = e.campaign_id group by all"""
    )

    # Silver
    sql["unify_conversion_scope"] = _query(
        """select event_id, user_id, event_type, campaign_id, event_ts, conversion_value
from both_tables where event_type <> 'CN'
union all
select event_id, user_id, event_type, campaign_id, event_ts, conversion_value
from (select *, row_number() over (partition by event_id order by event_ts desc,
        conversion_value desc nulls last) as rn from fx_conversion) where rn = 1"""
    )
    sql["unify_all"] = _query("select * from unified")
    sql["enrich"] = _query("select * from ev")

    # Features
    sql["feature_delta"] = _query(
        f"select * from ({_delta(_batch_filter(2), _clock(2))})"
    )
    sql["merge_user_features"] = _query("select * from features", _STATES)
    sql["rolling_features"] = _query("select * from rolling", _SCORES)
    sql["online_features"] = _query(
        f"""select user_id,
       cast(count(*) filter (where event_ts >= {AS_OF_SQL} - interval 1 hour) as bigint) as events_1h,
       cast(count(*) filter (where event_ts >= {AS_OF_SQL} - interval 24 hour) as bigint) as events_24h,
       cast(sum(cast(conversion_value as decimal(38,10)))
            filter (where event_ts >= {AS_OF_SQL} - interval 24 hour) as double) as conversion_value_24h,
       max(event_ts) as latest_event_48h
from ev where event_ts >= {AS_OF_SQL} - interval 48 hour and event_ts <= {AS_OF_SQL} group by user_id"""
    )
    sql["rolling_history"] = _query(
        f"select event_id, user_id, event_type, event_ts, {_HISTORY} from ev"
    )
    sql["feature_group"] = _query(
        """select r.*, round(p.propensity_score, 6) as propensity_score, p.score_bucket
from rolling r left join scores p on r.user_id = p.user_id""",
        _SCORES,
    )
    sql["training_frame"] = _query(
        """select user_id, cast(clicks_1h as double) as clicks_1h, cast(clicks_24h as double) as clicks_24h,
       cast(clicks_7d as double) as clicks_7d, cast(impressions_1h as double) as impressions_1h,
       cast(impressions_24h as double) as impressions_24h, cast(impressions_7d as double) as impressions_7d,
       cast(paid_search_1h as double) as paid_search_1h, cast(paid_search_24h as double) as paid_search_24h,
       cast(paid_search_7d as double) as paid_search_7d, event_velocity_24h,
       cast(case when conversions_total > 0 then 1 else 0 end as int) as converted
from features""",
        _STATES,
    )
    sql["label_stats"] = _query(
        """select count(*) as users, cast(count(*) filter (where conversions_total > 0) as bigint) as positives,
       cast(count(*) filter (where not conversions_total > 0) as bigint) as negatives,
       avg(case when conversions_total > 0 then 1.0 else 0.0 end) as positive_rate
from features""",
        _STATES,
    )
    sql["stratified_split"] = _query(
        """select user_id, converted,
       case when rn <= floor(cast(n as double) * cast(0.7 as double) + 0.5) then 'train' else 'test' end as split
from (select user_id, converted, count(*) over (partition by converted) as n,
             row_number() over (partition by converted order by md5('42:' || user_id), user_id) as rn
      from (select user_id, cast(case when conversions_total > 0 then 1 else 0 end as int) as converted
            from features))""",
        _STATES,
    )

    # Scoring and serving
    sql["score_fixed"] = _query(
        "select user_id, round(propensity_score, 6) as propensity_score, score_bucket from scores",
        _SCORES,
    )
    sql["score_requests"] = _query(
        f"""select event_id as request_id, user_id, round(propensity_score, 6) as propensity_score,
       {_BUCKET} as score_bucket
from (select e.event_id, e.user_id, {_SCORE} as propensity_score
      from ev e left join rolling on e.user_id = rolling.user_id where e.event_type = 'PS')""",
        _SCORES,
    )
    sql["latest_per_key"] = _query(
        """select user_id, event_id, event_type, event_ts from (
  select *, row_number() over (partition by user_id order by event_ts desc, event_id desc) as rn from ev)
where rn = 1"""
    )
    sql["serving_scores"] = _query(
        "select user_id, round(propensity_score, 6) as propensity_score, score_bucket, last_updated from scores",
        _SCORES,
    )
    sql["serving_campaigns"] = _query(
        "select * from performance", _PERFORMANCE
    )
    sql["top_users"] = _query(
        """select user_id, round(propensity_score, 6) as propensity_score, score_bucket, last_updated
from scores order by scores.propensity_score desc, user_id limit 20""",
        _SCORES,
    )
    sql["lookup_user"] = _query(
        """select s.user_id, round(s.propensity_score, 6) as propensity_score, s.score_bucket, s.last_updated
from scores s where s.user_id = 'U0005'""",
        _SCORES,
    )
    sql["lookup_features"] = _query("select * from features where user_id = 'U0005'", _STATES)
    _recent = """select event_id, user_id, event_type,
       case event_type when 'CL' then 'Click' when 'IM' then 'Impression'
            when 'PS' then 'Paid Search' when 'CN' then 'Conversion' end as event_label,
       campaign_name, channel, event_ts, conversion_value from ev"""
    sql["recent_events"] = _query(_recent + " order by event_ts desc, event_id limit 50")
    sql["recent_user_events"] = _query(
        _recent + " where user_id = 'U0005' order by event_ts desc, event_id limit 20"
    )
    sql["score_distribution"] = _query(
        "select score_bucket, count(*) as users from scores group by score_bucket", _SCORES
    )
    sql["recommendation_count"] = (
        r"select doc_id, cast(len(regexp_extract_all(text, '\d\.')) as bigint) as recommendations from documents"
    )
    sql["score_funnel"] = _query(
        """select b.score_bucket, coalesce(c.users, 0) as users,
       cast(sum(coalesce(c.users, 0)) over () as bigint) as total_users,
       coalesce(c.users, 0) * cast(100 as double) / greatest(max(coalesce(c.users, 0)) over (), 1) as bar_pct
from (values ('HIGH'), ('MED'), ('LOW')) as b(score_bucket)
left join (select score_bucket, count(*) as users
           from (select * from scores order by propensity_score desc, user_id limit 100)
           group by score_bucket) c on b.score_bucket = c.score_bucket""",
        _SCORES,
    )
    sql["top_summary"] = _query(
        """select count(*) as users_scored, cast(count(*) filter (where score_bucket = 'HIGH') as bigint) as high_users,
       round(avg(propensity_score), 3) as avg_score
from (select * from scores order by propensity_score desc, user_id limit 15)""",
        _SCORES,
    )
    sql["segment_preview"] = _query(
        f"""select user_id, round(score, 6) as propensity_score, score_bucket, clicks_24h, conversions_total
from (select f.user_id, p.propensity_score as score, p.score_bucket, f.clicks_24h, f.conversions_total
      {_SEGMENT}) order by score desc, user_id limit 50""",
        _SCORES,
        _STATES,
    )
    sql["segment_count"] = _query(f"select count(*) as cnt {_SEGMENT}", _SCORES, _STATES)

    # Campaigns
    sql["event_counts"] = _query(
        "select event_type, count(*) as events from both_tables group by event_type"
    )
    sql["campaign_performance"] = _query("select * from performance", _PERFORMANCE)
    sql["kpis"] = _query(
        """select *, cast(total_clicks as double) / nullif(total_impressions, 0) as ctr,
       cast(total_conversions as double) / nullif(total_clicks, 0) as conversion_rate,
       total_revenue / nullif(total_conversions, 0) as avg_order_value
from (select cast(sum(impressions) as bigint) as total_impressions, cast(sum(clicks) as bigint) as total_clicks,
             cast(sum(conversions) as bigint) as total_conversions,
             cast(sum(cast(revenue as decimal(38,10))) as double) as total_revenue,
             count(distinct unique_users) as total_reach from performance)""",
        _PERFORMANCE,
    )
    sql["reach_users"] = _query("select count(distinct user_id) as reach_users from ev")
    sql["campaign_summary"] = _query("select * from summary", _SUMMARY)
    sql["metrics_json"] = _query(
        """select '[' || string_agg(
         '{"campaign_name":' || coalesce('"' || campaign_name || '"', 'null')
         || ',"channel":' || coalesce('"' || channel || '"', 'null')
         || ',"impressions":' || impressions || ',"clicks":' || clicks
         || ',"conversions":' || conversions || ',"revenue":' || revenue
         || ',"ctr":' || coalesce(cast(ctr as varchar), 'null')
         || ',"conv_rate":' || coalesce(cast(conv_rate as varchar), 'null') || '}',
         ',' order by revenue desc, campaign_name nulls first, channel nulls first) || ']' as metrics
from summary""",
        _SUMMARY,
    )
    sql["hourly_channel_events"] = _query(
        "select hour_ts, channel, total_events from performance", _PERFORMANCE
    )
    sql["channel_hour_heatmap"] = _query(
        """select channel, hour_of_day, events,
       cast(events as double) / greatest(max(events) over (), 1) as intensity
from (select channel, cast(extract(hour from hour_ts) as bigint) as hour_of_day,
             cast(sum(total_events) as bigint) as events
      from performance where channel is not null group by 1, 2)""",
        _PERFORMANCE,
    )
    sql["reach_frequency"] = _query("select * from reach", _REACH)
    sql["reach_report"] = _query(
        """select campaign_name, channel, count(distinct user_id) as reach, avg(frequency) as avg_frequency,
       cast(count(*) filter (where frequency = 1) as bigint) as freq_1,
       cast(count(*) filter (where frequency between 2 and 3) as bigint) as freq_2_3,
       cast(count(*) filter (where frequency between 4 and 5) as bigint) as freq_4_5,
       cast(count(*) filter (where frequency >= 6) as bigint) as freq_6plus
from reach group by campaign_name, channel""",
        _REACH,
    )

    # Attribution
    sql["journeys"] = _query(
        """select user_id, touch_idx, touchpoint_count, conversion_value, channel,
       campaign_name as campaign, event_type, cast(event_ts as varchar) as ts from touches""",
        _JOURNEYS,
    )
    sql["journey_totals"] = _query("select * from totals", _JOURNEYS)
    for model in ("first_touch", "last_touch", "linear", "time_decay"):
        sql[f"attr_{model}"] = _attribution(model)
    sql["attr_linear_from_arrays"] = _query(
        """select channel, conversions, round(attributed_revenue, 6) as attributed_revenue from linear""",
        _ATTRIBUTION,
    )
    sql["attr_comparison"] = _comparison()

    # Monitoring
    sql["inference_log"] = _query(
        """select user_id, round(predicted_score, 6) as predicted_score, predicted_label,
       actual_converted, scored_at, model_version from inference_log""",
        _STATES,
        _LOG,
    )
    sql["monitor_daily"] = _query(
        """select c.*, cast(true_positives + true_negatives as double) / rows_scored as accuracy,
       cast(true_positives as double) / nullif(true_positives + false_positives, 0) as "precision",
       cast(true_positives as double) / nullif(true_positives + false_negatives, 0) as recall,
       case when 2 * true_positives + false_positives + false_negatives = 0 then 0
            else 2 * cast(true_positives as double)
                 / (2 * true_positives + false_positives + false_negatives) end as f1,
       round(d.psi, 6) as psi
from confusion c join drift d on c.day = d.day""",
        _STATES,
        _LOG,
        _MONITOR,
    )

    sql["monitor_drift"] = _query(
        """select day, cast(sum(n) as bigint) as scores, round(sum((p - q) * ln(p / q)), 6) as psi
from (select s.day, s.bin, s.n, greatest(cast(s.n as double) / s.total, 0.0001) as p,
             greatest(cast(coalesce(e.n, 0) as double) / (select sum(n) from base), 0.0001) as q
      from drift_shares s left join (
        select bin, sum(n) as n
        from (select n, (select count(*) from edges where edge <= cell) as bin from base) group by bin) e
      on s.bin = e.bin)
group by day""",
        _STATES,
        _LOG,
        f""",
cells as (
  select scored_at, date_trunc('day', scored_at) as day,
         greatest(least(cast(floor(round(predicted_score, 6) * 10000) as int), 9999), 0) as cell
  from inference_log),
base as (select cell, count(*) as n from cells where scored_at = {_clock(0)} group by cell),
placed as (select cell, sum(n) over (order by cell) - n as before, sum(n) over () as total from base),
edges as (
  select b, min(cell) filter (where before * 10 >= b * total) as edge
  from placed cross join (select unnest(range(1, 10)) as b) group by b),
drift_shares as (
  select d.day, b.bin, count(x.day) as n, sum(count(x.day)) over (partition by d.day) as total
  from (select distinct day from cells) d cross join (select unnest(range(10)) as bin) b
  left join (select day, (select count(*) from edges where edge <= cell) as bin from cells) x
    on x.day = d.day and x.bin = b.bin
  group by d.day, b.bin)""",
    )

    # Models
    sql["model_metrics"] = _query(
        """select round((sum(place) filter (where y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) as roc_auc,
       round(avg(case when hit = y then 1.0 else 0.0 end), 6) as accuracy,
       round(coalesce(2.0 * sum(hit * y) / nullif(2 * sum(hit * y) + sum(case when hit <> y then 1 else 0 end), 0), 0), 6) as f1
from (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as place,
             sum(y) over () as n1, sum(1 - y) over () as n0,
             case when p >= 0.5 then 1 else 0 end as hit
      from (select round(s.propensity_score, 6) as p, case when f.conversions_total > 0 then 1 else 0 end as y
            from scores s join features f on s.user_id = f.user_id))
group by n1, n0""",
        _STATES,
        _SCORES,
    )
    sql["champion"] = _query(
        """select model, roc_auc, cast(0.5 as double) as accuracy, f1
from (select campaign_id as model, cast(0.9 as double) + (count(*) % 3) * cast(0.05 as double) as roc_auc,
             (count(*) % 2) / cast(2 as double) as f1
      from unified group by campaign_id)
order by case when roc_auc >= 0.999 then 1 else 0 end, f1 desc, roc_auc desc, model limit 1"""
    )
    sql["registry_scores"] = _query(
        """select user_id, case when fixed > nobody then round(propensity_score, 6) else 0.0 end as propensity_score,
       case when fixed > nobody then score_bucket else 'LOW' end as score_bucket,
       case when fixed > nobody then 'V2' else 'V1' end as version,
       case when fixed > nobody then 'fixed' else 'nobody' end as champion,
       round(greatest(fixed, nobody), 6) as accuracy, cast(2 as bigint) as runs
from scores, (
  select avg(case when (propensity_score >= 0.5) = (conversions_7d > 0) then 1.0 else 0.0 end) as fixed,
         avg(case when conversions_7d > 0 then 0.0 else 1.0 end) as nobody
  from scores join rolling using (user_id))""",
        _SCORES,
    )
    sql["registry_versions"] = _query(
        "select 'V' || cast(max(n) filter (where n % 3 < 2) * 1000003 + 1 as varchar) as next_version from fx_base"
    )

    # Streaming jobs give what the batch query gives
    sql["stream_ingest"] = _query(
        f"""select 'marketing_events' as topic, event_id, user_id, event_type, campaign_id, event_ts,
       cast(null as double) as conversion_value, cast(null as varchar) as error
from fx_marketing where n % 50 <> 0 and n % 75 <> 1 and n % 90 <> 2
union all
select 'conversion_events', event_id, user_id, event_type, campaign_id, event_ts, conversion_value, null
from fx_conversion where n % 50 <> 0 and n % 75 <> 1 and n % 90 <> 2
union all
select topic, null, null, null, null, null, null, error
from ({_health('fx_marketing', 'marketing_events')} union all
      {_health('fx_conversion', 'conversion_events')}) where error is not null"""
    )
    sql["stream_enrich"] = sql["enrich"]
    sql["stream_unify"] = sql["unify_all"]
    sql["stream_dedup"] = _query(
        """select event_id, user_id, event_type, campaign_id, event_ts, conversion_value, arrival
from (select *, row_number() over (partition by event_id
        order by arrival, event_ts desc, conversion_value desc nulls last, event_type desc) as rn
      from (select *, cast((n + minute(event_ts) + hour(event_ts)) % 3 as bigint) as arrival
            from (select event_id, user_id, event_type, campaign_id, event_ts,
                    cast(null as double) as conversion_value, n from fx_marketing
                  union all
                  select event_id, user_id, event_type, campaign_id, event_ts, conversion_value, n
                  from fx_conversion)))
where rn = 1"""
    )
    sql["stream_pipeline"] = sql["serving_scores"]
    sql["stream_user_features"] = sql["merge_user_features"]
    sql["stream_tiles"] = sql["rolling_features"]
    sql["stream_tiles_watermark"] = sql["rolling_features"]
    sql["stream_tile_levels"] = sql["rolling_features"]
    sql["stream_online_levels"] = sql["online_features"]
    sql["stream_online_features"] = sql["online_features"]
    sql["stream_campaign_performance"] = sql["campaign_performance"]
    sql["stream_reach_frequency"] = sql["reach_frequency"]
    sql["stream_attribution"] = sql["attr_linear"]
    sql["stream_time_decay"] = sql["attr_time_decay"]
    sql["stream_journeys"] = sql["journeys"]
    sql["stream_latest_events"] = sql["latest_per_key"]
    return sql


ORACLE = _build()

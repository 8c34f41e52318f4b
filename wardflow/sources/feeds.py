"""Hospital feeds derived from an `events` table (event_id, ts, user_id, event_type, value, props)."""

# Department suffixes by node index.
SUFFIXES = ("TRIAGE", "RESUS", "FASTTRACK", "OBS", "RADIOLOGY", "BOARDING", "DISCHARGE")


_HOSPITAL = "concat('H', cast(user_id % 6 + 1 AS string))"
_SUFFIX_ARRAY = "array(" + ", ".join(f"'{s}'" for s in SUFFIXES) + ")"


def _dept(index):
    return f"concat_ws('_', {_HOSPITAL}, get({_SUFFIX_ARRAY}, cast({index} AS int)))"


def read_events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stream_events(spark, sf_dir, schema, **options):
    """The same table as a stream. The bracket makes the path a pattern, valid for file and folder."""
    return spark.readStream.schema(schema).options(**options).parquet(f"{sf_dir}/events.parque[t]")


def patient_events(events):
    """Arrivals, discharges and transfers in the wide patient schema."""
    here, there = _dept("user_id % 7"), _dept("(user_id + event_id % 6 + 1) % 7")

    def only(kind, value):
        return f"CASE WHEN event_type = '{kind}' THEN {value} END"

    return events.filter("event_type IN ('signup', 'purchase', 'click')").selectExpr(
        "cast(event_id AS string) AS event_id",
        "CASE event_type WHEN 'signup' THEN 'arrival' WHEN 'purchase' THEN 'discharge' "
        "ELSE 'transfer' END AS event_type",
        f"{_HOSPITAL} AS hospital_id",
        f"CASE WHEN event_type <> 'click' THEN {here} END AS dept_id",
        "cast(user_id AS string) AS patient_id",
        "CASE WHEN event_type <> 'purchase' THEN cast(event_id % 5 + 1 AS int) END AS acuity",
        only("signup", "ts") + " AS arrival_ts",
        only("purchase", "ts") + " AS discharge_ts",
        only("click", "ts") + " AS transfer_ts",
        only("click", here) + " AS source_dept_id",
        only("click", there) + " AS target_dept_id",
        only("signup", "value + 1") + " AS expected_los_minutes",
        only("purchase", "value + 1") + " AS actual_los_minutes")


def context_events(events):
    """Weather, flu and traffic readings in one wide shape."""
    weather, flu = "event_type = 'error'", "event_type = 'view' AND event_id % 10 = 0"
    road, rain = "event_type = 'view' AND event_id % 10 <> 0", "value / 20"
    boost = f"CASE WHEN {rain} > 10 THEN 0.3D ELSE 0.0D END"
    return events.filter("event_type IN ('error', 'view')").selectExpr(
        "cast(event_id AS string) AS event_id",
        f"CASE WHEN {weather} THEN 'weather' WHEN {flu} THEN 'flu_index' ELSE 'traffic' END AS event_type",
        f"{_HOSPITAL} AS hospital_id", "ts AS event_ts",
        f"CASE WHEN {weather} THEN value / 10 END AS temperature_c",
        f"CASE WHEN {weather} THEN {rain} END AS precipitation",
        f"CASE WHEN {weather} THEN {rain} > 10 END AS is_severe",
        f"CASE WHEN {weather} THEN least(1.0D, value / 300 + {boost}) END AS weather_score",
        f"CASE WHEN {flu} THEN value % 10 END AS flu_index",
        f"CASE WHEN {road} THEN value % 100 / 100 END AS congestion_score",
        f"CASE WHEN {road} THEN 60 - value % 50 END AS avg_speed_kmh")


def prediction_pairs(events):
    return events.selectExpr("event_id", f"{_HOSPITAL} AS hospital_id", "ts",
                             "cast(event_id % 97 AS double) / 97 AS predicted",
                             "least(1.0D, value / 200) AS actual")


def raw_forecasts(events):
    """One forecast per event for one department; the 8 h score is missing now and then."""
    return events.selectExpr(
        "event_id", f"{_HOSPITAL} AS hospital_id", f"{_dept('user_id % 7')} AS dept_id", "ts",
        *[f"cast(event_id % {p} AS double) / {p} AS {h}" for h, p in (("h1", 97), ("h2", 89), ("h4", 83))],
        "CASE WHEN event_id % 10 <> 0 THEN cast(event_id % 79 AS double) / 79 END AS h8")


def model_rows(events):
    """A model registry feed: versions per hospital with their metrics as JSON text."""
    return events.selectExpr(
        f"{_HOSPITAL} AS hospital_id", "concat('v', cast(event_id AS string)) AS model_version",
        "ts AS trained_at", "props AS metrics_json", "event_id % 7 = 0 AS is_active")

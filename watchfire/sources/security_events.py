"""The normalised security event table and its adapter over the given `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of a normalised event that a rule's field name can mean directly.
EVENT_FIELDS = (
    "id", "timestamp", "source", "event_type", "severity", "source_ip", "destination_ip", "source_port",
    "destination_port", "username", "hostname", "process_name", "command_line", "message", "raw_data",
)

#: The same mapping in Spark SQL and in DuckDB, where {json} reads the key k of props and {us} gives microseconds.
ADAPTER = """
    SELECT event_id AS id, ts AS `timestamp`, {us} AS us,
           CASE event_type WHEN 'error' THEN 'linux_auth' WHEN 'signup' THEN 'linux_auth' WHEN 'click' THEN 'suricata'
                           WHEN 'view' THEN 'nginx' ELSE 'windows' END AS source,
           CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'signup' THEN 'successful_login'
                           WHEN 'click' THEN 'network_connection' WHEN 'view' THEN 'web_request' ELSE 'process_create' END AS event_type,
           CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'high' WHEN value >= 50 THEN 'medium'
                WHEN value >= 10 THEN 'low' ELSE 'info' END AS severity,
           concat('10.0.', user_id % 7, '.', user_id % 251) AS source_ip, CAST(NULL AS {string}) AS destination_ip,
           CAST(NULL AS INT) AS source_port, CAST({json} AS INT) AS destination_port,
           concat('user', user_id) AS username, concat('host-', user_id % 20) AS hostname,
           CAST(NULL AS {string}) AS process_name, CAST(NULL AS {string}) AS command_line,
           concat('event ', event_id, ' of ', event_type) AS message, props AS raw_data
    FROM {table}
"""


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised events; `us` is the event time in microseconds, free of any time zone."""
    return adapted(spark.read.parquet(f"{sf_dir}/events.parquet"))


def adapted(given: DataFrame) -> DataFrame:
    """The table `events`, given as a batch or a stream, as normalised events."""
    sql = ADAPTER.format(
        us="timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))",
        json="get_json_object(props, '$.k')", string="STRING", table="{given}",
    )
    return given.sparkSession.sql(sql, given=given)


def adapter_cte() -> str:
    """The adapter as a DuckDB subquery."""
    sql = ADAPTER.format(us="epoch_us(ts)", json="json_extract_string(props, '$.k')", string="VARCHAR", table="events")
    return sql.replace("`timestamp`", '"timestamp"')

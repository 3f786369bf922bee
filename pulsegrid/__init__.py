"""Company monitoring on Spark: DataFrame operators over snapshots, news, links and people."""

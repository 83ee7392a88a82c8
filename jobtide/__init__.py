"""jobtide: a Spark-native engine for corpora of job postings.

Layers: ``functions`` (column expressions), ``sources`` (landed payloads, slug
lists, sinks), ``operators`` (DataFrame in, DataFrame out), ``plans`` (whole
jobs built from operators) and ``workloads`` (registered queries over the
driver's tables together with the SQL that checks them).
"""

"""Planning on the driver: pure Python over counts that are bounded by partitions and buckets."""

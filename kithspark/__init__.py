"""Identity-graph analytics on Spark: detections, identities, relations, placement."""

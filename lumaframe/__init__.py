"""lumaframe: images as Spark rows."""

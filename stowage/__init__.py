"""Spark-native packing engine: manifests, blocks, deflate, checksums, archive layout and sinks."""

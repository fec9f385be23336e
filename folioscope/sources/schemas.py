"""Schemas of the records that are read."""

POINTER = "revision_id string, revision_key string"
SNAPSHOT = "artifacts array<struct<path:string,content_b64:string,sha256:string,size:bigint>>"

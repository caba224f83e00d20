"""Schemas of the tables that operators exchange."""

SPANS = (
    "environment string, trace_id string, span_id string, parent_id string, service string, operation string, "
    "start_us bigint, duration_us bigint, is_error boolean, tags map<string,string>, event_time timestamp"
)
OTLP = (
    "resourceSpans array<struct<resource struct<attributes array<struct<key string, value struct<stringValue string>>>>, "
    "scopeSpans array<struct<spans array<struct<traceId string, spanId string, parentSpanId string, name string, "
    "startTimeUnixNano string, endTimeUnixNano string, status struct<code int>, "
    "attributes array<struct<key string, value struct<stringValue string>>>>>>>>>"
)
TRACE_DOCS = (
    "traceID string, startTime bigint, duration bigint, spans array<struct<spanID string, operationName string, "
    "serviceName string, startTime bigint, duration bigint, tags array<struct<key string, value string>>>>"
)
ENVELOPE = "eventType string, category string, metadata map<string,string>, properties map<string,string>, timestampMs bigint"

"""Schemas of tables that the engine reads or keeps."""

#: A recorded message; payload_id is unique, tables are clustered by session_id.
PAYLOADS = (
    "message_id string, transaction_id string, flow_id string, payload_id string, action string, bpp_id string, bap_id string, req_header string, json_request string, json_response string, "
    "http_status int, action_id string, session_id string, created_at timestamp, updated_at timestamp"
)
#: A row of a validation table: a group or a leaf.
VALIDATION_ROWS = "domain string, version string, action string, row_type string, name string, `group` string, scope string, description string, skip_if string, error_code string, success_code string"
KNOWLEDGE = "key string, info string"

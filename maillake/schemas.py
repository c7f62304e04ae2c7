"""Schemas of the tables a conversion makes."""

ATTACHMENT = "struct<hash:string,path:string,name:string,size:bigint,type:string>"
MESSAGES = "file string, ordinal bigint, raw binary"
PART = "struct<name:string,ext:string,content_type:string,hash:string,size:bigint,data:binary>"
MAIL = (
    "struct<key:string,path:string,message_id:string,date_iso:string,date_utc:timestamp,offset_s:int,local_ts:timestamp,"
    "sender:string,to:array<string>,cc:array<string>,subject:string,labels:array<string>,thread_id:string,"
    f"body:string,body_kind:string,attachments:array<{PART}>>"
)
PARSED = f"file string, ordinal bigint, key string, status string, error string, message_id string, msg {MAIL}"
MANIFEST = (
    "key string, path string, message_id string, date string, subject string, labels array<string>, thread_id string, "
    f"body string, attachments array<{ATTACHMENT}>, `from` string"
)
LEDGER_FILE, MANIFEST_FILE, INDEX_FILE, ERRORS_FILE = ".maillake-files", "messages.jsonl", "attachments/index.jsonl", "_unparsed/errors.jsonl"
#: What tasks of an unfinished run have written, as manifest rows; a finished run leaves none.
PARTS_FOLDER = ".maillake-parts"

"""Row types of the data model, as DDL; every operator states its columns in these terms."""

from __future__ import annotations

FUNCTION = "struct<name:string,signature:string,line_start:int,line_end:int,exported:boolean>"
TYPE = "struct<name:string,kind:string,line_start:int,line_end:int,exported:boolean>"
IMPORT = "struct<path:string,internal:boolean,resolved_path:string>"
STORED_IMPORT = "struct<path:string,internal:boolean>"
ENTRY = f"struct<language:string,content_hash:string,functions:array<{FUNCTION}>,types:array<{TYPE}>,imports:array<{IMPORT}>>"
STORED_ENTRY = f"struct<language:string,content_hash:string,functions:array<{FUNCTION}>,types:array<{TYPE}>,imports:array<{STORED_IMPORT}>>"
FILE_INDEX = f"path string, language string, content_hash string, functions array<{FUNCTION}>, types array<{TYPE}>, imports array<{IMPORT}>"
NODES = "path string"
EDGES = "src string, dst string"
MODULES = "id string, pos int, files array<string>, shared boolean, owner string, depends_on_shared array<string>, referenced_by array<string>"
CHANGES = "path string, old_path string, type string"
KEY_FUNCTION = "struct<name:string,signature:string,ref:string>"
SHARED_CONTEXT = f"module_id string, summary string, key_types array<string>, key_functions array<{KEY_FUNCTION}>, source_refs array<string>"
ERROR = "struct<status:int,message:string,retryable:boolean>"
MODULE_DOCS = f"module_id string, content string, error {ERROR}"
DOCS = "path string, content string"
BROKEN_LINKS = "source_file string, link_text string, link_target string, line int"
REQUESTS = "module_id string, model string, system string, user string, max_tokens int, temperature float"

AGENT, PREPROCESSOR = "agent", "shared_preprocessor"
OWNERS = (AGENT, PREPROCESSOR)

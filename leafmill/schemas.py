"""Table schemas (DDL strings) shared by sources and operators."""

FIELD = "struct<id:string,name:string,selector:string,attribute:string>"

API = (
    "struct<method:string,headers:map<string,string>,body:string,"
    "pageParam:string,startPage:int>"
)

CONFIG = (
    "struct<url:string,sourceType:string,renderMode:string,renderWaitMs:int,"
    f"waitSelector:string,rowSelector:string,nextSelector:string,maxPages:int,fields:array<{FIELD}>,api:{API}>"
)

RULES = f"id string, name string, config {CONFIG}, updatedAt string"

RESPONSES = (
    "response_id long, run_id string, page_index int, url string, status int, "
    "headers map<string,string>, content_type string, body binary"
)

PAGE = "struct<url:string,title:string,rows:int,duration:long>"

REPORT = (
    "struct<operation:string,status:int,contentType:string,sourceType:string,rendered:boolean,"
    "matched:int,sampled:int,"
    "fields:array<struct<name:string,selector:string,attribute:string,filled:int>>,"
    "notes:array<string>>"
)

RESULT = (
    f"struct<rows:array<map<string,string>>,pages:array<{PAGE}>,fields:array<string>,"
    "warnings:array<string>,duration:long,completedAt:string>"
)

EVENTS = (
    "run_id string, pos long, type string, message string, level string, "
    f"page {PAGE}, rows array<map<string,string>>, report {REPORT}, result {RESULT}"
)

# One entry per element or text run, in document order. Entry 0 is the document itself.
NODE = (
    "struct<pre:int,n_desc:int,parent:int,prev:int,tag:string,attrs:map<string,string>,"
    "classes:array<string>,sib:int,n_sib:int,sib_of_type:int,n_sib_of_type:int,"
    "path:array<int>,text:string>"
)
NODES = f"array<{NODE}>"

"""Schemas that the plans share, as DDL."""

SPAN = "struct<start:int,end:int,word:string>"
SPANS = f"array<{SPAN}>"
ENTITY = "struct<word:string,entity_group:string,score:double,start:int,end:int,source:string,context:string,anomaly_score:double,placeholder:string,sources:array<string>>"
ENTITIES = f"array<{ENTITY}>"
ISSUE = "struct<type:string,pii_type:string,position:int,snippet:string,description:string>"
ISSUES = f"array<{ISSUE}>"
AUDIT = "struct<timestamp:timestamp,document_id:string,entity_word:string,entity_group:string,confidence:double,source_layer:string,action:string,placeholder:string,context_snippet:string,reviewer:string,review_decision:string>"
AUDITS = f"array<{AUDIT}>"
BENCHMARK = "id string, text string, entities array<struct<start:int,end:int,type:string>>, _corrupt_record string"

"""Schemas of the tables between stages. `seq` is a total order of records: merges depend on it."""

from __future__ import annotations

SOURCE = "struct<document_id:string,page_num:int,section:string>"
PROPERTIES = "map<string,variant>"

PARSED = """id string, name string, metadata struct<page_count:int,format:string,file_path:string>,
    pages array<struct<page_number:int,blocks:array<struct<block_type:string,block_order:int,content:string>>>>"""
ENTITY = f"struct<id:string,type:string,properties:{PROPERTIES},source:{SOURCE}>"
RELATIONSHIP = f"struct<source_id:string,target_id:string,type:string,properties:{PROPERTIES},source:{SOURCE}>"
EXTRACTION = f"document_id string, entities array<{ENTITY}>, relationships array<{RELATIONSHIP}>, errors array<struct<pages:string,message:string>>"
RESPONSE = f"struct<entities:array<{ENTITY}>,relationships:array<{RELATIONSHIP}>>"
NODES = f"entity_id string, entity_type string, labels array<string>, name string, properties {PROPERTIES}, sources array<string>, first_doc_ord long"
EDGES = f"src string, type string, tgt string, properties {PROPERTIES}, sources array<string>"

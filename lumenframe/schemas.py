"""Schemas of the entities."""

from __future__ import annotations

FILE = "path string, dir string, name string, stem string, suffix string, ext string, is_symlink boolean, size long, mtime_ns long, ctime_ns long, inode long, device long, nlink int, head binary, birthtime double"

STREAM = (
    "struct<index:int,codec_type:string,codec_name:string,codec_tag_string:string,profile:string,start_time:string,duration:string,"
    "tags:map<string,string>,disposition:map<string,int>,width:int,height:int,pix_fmt:string,bits_per_raw_sample:string,field_order:string,"
    "avg_frame_rate:string,r_frame_rate:string,sample_aspect_ratio:string,rotation:double,color:map<string,string>,attached_pic:boolean,"
    "side_data_types:array<string>,sample_rate:string,channels:int,channel_layout:string,sample_fmt:string>"
)
CHAPTER = "struct<start_time:string,end_time:string,title:string>"
GROUP = "struct<index:int,id:string,type:string>"
INVENTORY = f"struct<streams:array<{STREAM}>,chapters:array<{CHAPTER}>,stream_groups:array<{GROUP}>>"

# what a probe writes, before normalisation
RAW_STREAM = (
    "struct<index:int,codec_type:string,codec_name:string,codec_tag_string:string,profile:string,start_time:string,duration:string,"
    "tags:map<string,string>,disposition:map<string,int>,width:int,height:int,pix_fmt:string,bits_per_raw_sample:string,field_order:string,"
    "avg_frame_rate:string,r_frame_rate:string,sample_aspect_ratio:string,color_range:string,color_space:string,color_transfer:string,"
    "color_primaries:string,chroma_location:string,side_data_list:array<map<string,string>>,sample_rate:string,channels:int,channel_layout:string,sample_fmt:string>"
)
RAW_INVENTORY = (
    f"struct<streams:array<{RAW_STREAM}>,chapters:array<struct<start_time:string,end_time:string,tags:map<string,string>>>,"
    "stream_groups:array<struct<index:int,id:string,type:string,group_type:string>>>"
)
PACKET = "path string, pos long, stream_index string, pts_time string, dts_time string, duration_time string"
OUTCOME = "status string, path string, detail string, bytes_saved long"
IDENTITY = "struct<m:long,c:long,s:long,i:long,d:long>"
CACHE = f"kind string, path string, identity {IDENTITY}, f string, value string"
JOURNAL = "struct<version:int,started_at:string,updated_at:string,finished_at:string,interrupted:boolean,files:map<string,struct<kind:string,identity:struct<size:long,mtime_ns:long>,status:string,detail:string,updated_at:string>>>"
PLAN = "struct<root:string,renames:array<struct<`from`:string,`to`:string>>>"

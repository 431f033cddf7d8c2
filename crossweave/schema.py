"""Column types of the tables that the engine reads and writes."""

ASSIGNMENTS = "name string, source string, variant string, aid string, ord int, pid string"
AUTHOR = "struct<name:string,org:string,OriginalAuthor:string,OriginalAffiliation:string,AuthorSequenceNumber:int>"
PAPER = f"struct<title:string,authors:array<{AUTHOR}>,venue:string,year:int,keywords:array<string>>"
TRIPLES = "name string, aid1 string, aid2 string, pid string, label int, soft_label double, similarity double, author_sim double, p_out_sim double, ord long"
PRIOR = "pid string, pred double"
REQUESTS = "request_id string, name string, aid1 string, aid2 string, pids array<string>, author_sim double, prompt string"
REPLIES = "request_id string, content string, reasoning string, attempts int"
REFINED = "name string, aid1 string, aid2 string, pid string, batch_idx int, old_pred double, new_pred double"

"""The library run on the driver's test tables, and the SQL that states what must come out."""

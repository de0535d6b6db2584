"""flowledger: Spark DataFrame operators over transfer ledgers, market series and the tables around them."""

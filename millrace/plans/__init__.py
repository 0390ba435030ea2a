"""The SQL dialect: lexer, parser, analyzer and compiler to DataFrame plans."""

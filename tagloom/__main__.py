from tagloom.cli import main

main()
